"""Structured Streaming: mentions and relations arrive in micro-batches, the
resolved tables follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import resolve
from weftline.sources.tables import AppendedTable


class IncrementalResolver:
    """Keeps all mentions and relations seen, each once by its id, in tables that
    only grow. A batch that comes twice, as after a restart, adds nothing. What a
    batch changes can be resolved alone, or everything."""

    def __init__(self, spark: SparkSession, folder: str):
        self.mentions = AppendedTable(spark, f"{folder}/mentions", "entity_id")
        self.relations = AppendedTable(spark, f"{folder}/relations", "relationship_id")

    def add(self, mentions: DataFrame | None = None, relations: DataFrame | None = None) -> None:
        for table, new in ((self.mentions, mentions), (self.relations, relations)):
            if new is not None:
                table.append(new)

    def tables(self, **how) -> dict[str, DataFrame]:
        return resolve.resolve(self.mentions.read(), self.relations.read(), **how)

    def touched(self, batch: DataFrame, fold: bool = True, version: int = 1) -> DataFrame:
        """The resolved entities that a batch of mentions changes, over all mentions seen."""
        ids = resolve.keyed_mentions(batch, fold, version).select("resolved_id").distinct()
        own = resolve.keyed_mentions(self.mentions.read(), fold, version).join(ids, "resolved_id", "left_semi")
        return resolve.resolved_entities(own.drop("resolved_id", "normalized_key"), fold, version)

    def sink(self, kind: str = "mentions") -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda batch, _: self.add(**{kind: batch})


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by time window and type, with a watermark on a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
