"""Entity resolution: canonical ids, merging by label, and blocking with resolved
tables and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import names


def rewritten(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges (src, predicate, dst) with both ends moved by ``moves`` (old_id,
    new_id); ids without a move stay; distinct."""
    s, d = moves.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), moves.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("s", "src").alias("src"), "predicate", F.coalesce("d", "dst").alias("dst")).distinct()


def canonical_id(node_id: Column, protected=names.PROTECTED_PREFIXES, synonym: Column | None = None) -> Column:
    """prefix:slug of the value. Protected prefixes, and values of which a slug
    leaves nothing, stay as they are. synonym: a value to take in place of the id's
    own, where it is not null."""
    prefix = names.prefix_of(node_id)
    value = names.squeeze(names.value_of(node_id))
    slugged = names.canonical_value(value if synonym is None else F.coalesce(synonym, value))
    return F.when(prefix.isin(*protected) | (slugged == ""), node_id).otherwise(F.concat_ws(":", prefix, slugged))


def canonical_moves(ids: DataFrame, protected=names.PROTECTED_PREFIXES, synonyms: dict[str, dict[str, str]] | DataFrame | None = None) -> DataFrame:
    """(old_id, new_id) of ids (old_id). synonyms: prefix -> lower-case value ->
    value, or a frame (prefix, alias, value) of any size; they are joined."""
    if synonyms is None or (isinstance(synonyms, dict) and not any(synonyms.values())):
        return ids.select("old_id", canonical_id(F.col("old_id"), protected).alias("new_id"))
    if isinstance(synonyms, dict):
        flat = {(p, alias.lower()): to for p, table in synonyms.items() for alias, to in table.items()}
        synonyms = ids.sparkSession.createDataFrame([(p, a, to) for (p, a), to in flat.items()], "prefix string, alias string, value string")
    known = synonyms.groupBy(F.col("prefix").alias("_p"), F.lower("alias").alias("_a")).agg(F.min("value").alias("_v"))
    old = F.col("old_id")
    met = ids.join(known, (names.prefix_of(old) == F.col("_p")) & (F.lower(names.squeeze(names.value_of(old))) == F.col("_a")), "left")
    return met.select("old_id", canonical_id(old, protected, F.col("_v")).alias("new_id"))


def resolve_entities(nodes: DataFrame, edges: DataFrame, protected=names.PROTECTED_PREFIXES, synonyms=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, moves): ids replaced by canonical ones; see canonical_moves."""
    moves = canonical_moves(nodes.select(F.col("node_id").alias("old_id")).distinct(), protected, synonyms)
    if synonyms is None:

        def to(c: str) -> Column:
            return canonical_id(F.col(c), protected).alias(c)

        moved = edges.select(to("src"), "predicate", to("dst")).distinct()
    else:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("old_id")).distinct()
        moved = rewritten(edges, canonical_moves(ends, protected, synonyms))
    return moves.select(F.col("new_id").alias("node_id")).distinct(), moved, moves


def merge_statistics(moves: DataFrame) -> DataFrame:
    """(prefix, merged): ids of a prefix that went into another."""
    return moves.groupBy(names.prefix_of(F.col("old_id")).alias("prefix")).agg((F.count_distinct("old_id") - F.count_distinct("new_id")).alias("merged"))


def resolve_simple(nodes: DataFrame, edges: DataFrame, order: str = "node_id", prune: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, moves): ids whose labels are equal but for signs are one,
    whatever their prefix; the first by ``order`` stands for all. Ids without a
    letter or digit stay. prune: nodes without an edge go."""
    key = names.merge_label(F.col("node_id"))
    one = nodes.groupBy("node_id").agg(F.min(order).alias("ord")) if order != "node_id" else nodes.select("node_id", F.col("node_id").alias("ord")).distinct()
    keyed = one.withColumn("k", key)
    first = keyed.where("k <> ''").groupBy("k").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("new_id"))
    moves = keyed.join(first, "k", "left").select(F.col("node_id").alias("old_id"), F.coalesce("new_id", "node_id").alias("new_id"))
    new_edges = rewritten(edges, moves)
    new_nodes = moves.select(F.col("new_id").alias("node_id")).distinct()
    if prune:
        new_nodes = new_nodes.join(new_edges.select(F.explode(F.array("src", "dst")).alias("node_id")), "node_id", "left_semi")
    return new_nodes, new_edges, moves


def keyed_mentions(mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
    key = names.normalized_key(F.col("name"), F.col("type"), fold, version)
    return mentions.withColumn("normalized_key", key).withColumn("resolved_id", names.resolved_id(F.col("normalized_key")))


def resolved_entities(mentions: DataFrame, fold: bool = True, version: int = 1, mapping: DataFrame | None = None) -> DataFrame:
    """One row for each block of mentions with the same type and normal name, or of
    those that ``mapping`` (entity_id, resolved_id) puts together: the most frequent
    name (then the longest, then the first), the category of the first mention by
    id, counts of mentions and documents, first and last seen. The key of several
    is the one that the id is made of, if there is such a one, else the first."""
    m = keyed_mentions(mentions, fold, version)
    if mapping is not None:
        m = m.drop("resolved_id").join(mapping.select("entity_id", "resolved_id").distinct(), "entity_id")
        own = F.when(names.resolved_id(F.col("normalized_key")) == F.col("resolved_id"), F.col("normalized_key"))
        keys = m.groupBy("resolved_id").agg(F.coalesce(F.min(own), F.min("normalized_key")).alias("normalized_key"))
        m = m.drop("normalized_key").join(keys, "resolved_id")
    names_of = m.where(F.coalesce(F.col("name"), F.lit("")) != "").groupBy("resolved_id", "name").agg(F.count("*").alias("n"))
    primary = names_of.groupBy("resolved_id").agg(F.min_by("name", F.struct(-F.col("n"), -F.length("name"), "name")).alias("name"))
    blocks = m.groupBy("resolved_id", "normalized_key").agg(
        F.min_by("type", "entity_id").alias("type"), F.min_by("category", "entity_id").alias("category"),
        F.count("*").alias("mention_count"), F.count_distinct("document_id").alias("doc_count"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
    return blocks.join(primary, "resolved_id", "left").select("resolved_id", F.coalesce("name", F.lit("")).alias("name"), "type", "category", "normalized_key", "mention_count", "doc_count", "first_seen_at", "last_seen_at")


def resolution_map(mentions: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
    """(entity_id, resolved_id, strategy, confidence)."""
    return keyed_mentions(mentions, fold, version).select("entity_id", "resolved_id", F.lit("exact").alias("strategy"), F.lit(1.0).alias("confidence")).distinct()


def filled_map(rows: DataFrame) -> DataFrame:
    """Map rows with what they lack: strategy exact, confidence 1."""
    have = {f.name for f in rows.schema}
    strategy = F.coalesce("strategy", F.lit("exact")) if "strategy" in have else F.lit("exact")
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in have else F.lit(1.0)
    return rows.select("entity_id", "resolved_id", strategy.alias("strategy"), confidence.alias("confidence"))


def resolved_mentions(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with both ends resolved, and the resolved relation's id; relations
    with an unknown end are left out."""
    m = mapping.select("entity_id", "resolved_id")
    s, t = m.select(F.col("entity_id").alias("source_entity_id"), F.col("resolved_id").alias("source_resolved_id")), m.select(F.col("entity_id").alias("target_entity_id"), F.col("resolved_id").alias("target_resolved_id"))
    both = relations.join(s, "source_entity_id").join(t, "target_entity_id")
    return both.withColumn("resolved_relationship_id", names.relation_id(F.col("source_resolved_id"), F.col("relation"), F.col("target_resolved_id")))


def resolved_edges(provenance: DataFrame) -> DataFrame:
    """One row for each resolved relation: weight (mentions), documents, first and last seen."""
    return provenance.groupBy("resolved_relationship_id", "source_resolved_id", "relation", "target_resolved_id").agg(
        F.count("*").alias("weight"), F.count_distinct("document_id").alias("doc_count"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))


#: So many values are compared as literals; more are a table to join.
LITERALS = 200


def among(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values, which may be many."""
    if not values:
        return df.limit(0)
    if len(values) <= LITERALS:
        return df.where(F.col(column).isin(*values))
    chosen = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"_chosen {df.schema[column].dataType.simpleString()}")
    return df.join(chosen, F.col(column) == F.col("_chosen"), "left_semi")


def in_scope(df: DataFrame, documents: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Rows of some documents and of a time span (end not included)."""
    if documents is not None:
        df = among(df, "document_id", documents)
    if start is not None:
        df = df.where(F.col("created_at") >= F.lit(start))
    return df if end is None else df.where(F.col("created_at") < F.lit(end))


def resolve(mentions: DataFrame, relations: DataFrame, documents: list[str] | None = None, fold: bool = True, version: int = 1, matcher=None) -> dict[str, DataFrame]:
    """The resolved tables, by name; running it again over the same rows gives the
    same. matcher: see ``matchers``; mentions are matched by normal name without one."""
    mentions, relations = in_scope(mentions, documents), in_scope(relations, documents)
    mapping = matcher.map(mentions, fold, version) if matcher else resolution_map(mentions, fold, version)
    provenance = resolved_mentions(relations, mapping)
    return {
        "resolved_entities": resolved_entities(mentions, fold, version, mapping if matcher else None),
        "entity_resolution_map": mapping,
        "resolved_relationships": resolved_edges(provenance),
        "resolved_relationship_mentions": provenance.select("resolved_relationship_id", "relationship_id", "document_id", "chunk_id").distinct(),
    }


def run_statistics(mentions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counters for a run."""
    counts = [mentions.agg(F.count("*").alias("mentions"))]
    counts += [tables[t].agg(F.count("*").alias(n)) for n, t in (("entities", "resolved_entities"), ("relationships", "resolved_relationships"), ("provenance", "resolved_relationship_mentions"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, F.lit(True))  # one row each
    return out


def resolved_snapshot(tables: dict[str, DataFrame], mentions: DataFrame, documents: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolved nodes, with the documents that mention them, and edges. With
    documents given: the edges that these mention, and the nodes at them; none if
    there are none."""
    found = tables["resolved_relationships"]
    entities = tables["resolved_entities"]
    if documents is not None:
        own = among(tables["resolved_relationship_mentions"], "document_id", documents)
        found = found.join(own.select("resolved_relationship_id"), "resolved_relationship_id", "left_semi")
        ends = found.select(F.explode(F.array("source_resolved_id", "target_resolved_id")).alias("resolved_id"))
        entities = entities.join(ends, "resolved_id", "left_semi")
    docs = mentions.join(tables["entity_resolution_map"], "entity_id").groupBy("resolved_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    none = F.array().cast("array<string>")
    return entities.join(docs, "resolved_id", "left").withColumn("documents", F.coalesce("documents", none)), found


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
