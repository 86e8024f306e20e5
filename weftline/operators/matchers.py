"""Matchers: which mentions are the same entity. Each gives (entity_id, resolved_id,
strategy, confidence) for mentions; ``resolve.resolve(..., matcher=)`` takes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import names

from . import similar, vectors
from .iterate import components
from .resolve import keyed_mentions, resolution_map


class ExactMatcher:
    """Mentions of one type and normal name."""

    def map(self, mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
        return resolution_map(mentions, fold, version)


class FuzzyMatcher:
    """Mentions of one type whose normal names are ``k`` edits apart or fewer, or
    equal. Names are stars about centres, the most frequent first: an entity has the
    id of its centre's name, and every name in it is within k edits of that name.
    confidence: 1 less the edits over the longer name's length."""

    def __init__(self, k: int = 1, split: int = similar.SPLIT):
        self.k, self.split = k, split

    def centres(self, mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
        """(normalized_key, centre, distance) of each key of the mentions."""
        keyed = keyed_mentions(mentions, fold, version)
        name = names.normalize_name(F.col("name"), F.col("type"), fold, version)
        block = F.lower(F.coalesce(F.col("type"), F.lit("")))
        counted = keyed.select(block.alias("block"), name.alias("name"), F.col("normalized_key").alias("node")).groupBy("block", "name", "node").agg(F.count("*").alias("weight"))
        pairs = similar.edit_pairs(counted.select("block", "name"), self.k, self.split)
        ids = counted.select("block", "name", "node")
        a, b = ids.withColumnsRenamed({"name": "a", "node": "na"}), ids.withColumnsRenamed({"name": "b", "node": "nb"})
        links = pairs.join(a, ["block", "a"]).join(b, ["block", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"), "distance")
        return similar.stars(counted.select("node", "weight"), links).withColumnRenamed("node", "normalized_key")

    def map(self, mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
        to = self.centres(mentions, fold, version)
        longest = F.greatest(F.length(names.value_part(F.col("normalized_key"))), F.length(names.value_part(F.col("centre"))), F.lit(1))
        met = keyed_mentions(mentions, fold, version).select("entity_id", "normalized_key").distinct().join(to, "normalized_key")
        return met.select(
            "entity_id", names.resolved_id(F.col("centre")).alias("resolved_id"), F.when(F.col("distance") == 0, "exact").otherwise("fuzzy").alias("strategy"),
            (1 - F.col("distance") / longest).alias("confidence")).distinct()


class EmbeddingMatcher:
    """Mentions of one type whose vectors (entity_id, vector) have a cosine of
    ``least`` or more, and whatever these connect; mentions without a usable vector
    by their normal name. An entity's id is that of the least of its vectors' mentions.
    exact: all vectors are compared. how: see vectors.candidates."""

    def __init__(self, of: DataFrame, least: float = 0.9, exact: bool = False, **how):
        self.of, self.least, self.exact, self.how = of, least, exact, how

    def map(self, mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
        keyed = keyed_mentions(mentions, fold, version).select("entity_id", "resolved_id", F.lower(F.coalesce(F.col("type"), F.lit(""))).alias("block")).distinct()
        own = self.of.join(keyed.select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("id"), "vector")
        classes, roots = vectors.vector_classes(own)
        pairs = vectors.exact_pairs(roots, self.least) if self.exact else vectors.similar_pairs(roots, self.least, **self.how)
        # A class of equal vectors is linked through its root; types part what vectors join.
        group = components(roots.select(F.col("root").alias("node_id")), pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node_id").alias("root"), "component")
        placed = keyed.join(classes.withColumnRenamed("id", "entity_id"), "entity_id", "left").join(group, "root", "left")
        by = F.concat_ws("|", "block", F.lit("vector"), F.col("component").cast("string"))
        return placed.select(
            "entity_id", F.when(F.col("component").isNull(), F.col("resolved_id")).otherwise(names.resolved_id(by)).alias("resolved_id"),
            F.when(F.col("component").isNull(), "exact").otherwise("embedding").alias("strategy"), F.when(F.col("component").isNull(), 1.0).otherwise(self.least).alias("confidence")).distinct()
