"""Resolution as maintained state: a stream of mentions keeps tallies per entity, and
a batch adds what it brings. Nothing is counted again, and no mention is kept longer
than it can still come twice.

State is kept by ``transformWithState`` under (resolved_id, part), a mention's part
being a hash of its own id: the mentions of an entity that very many name are spread
over parts, while two arrivals of one mention meet in one. Per key: mentions per
name, per document, first and last time, and the ids whose time the watermark has not
passed yet. A mention older than the watermark is late and dropped, so an id
older than it cannot count twice and a timer forgets it.

``entities`` and ``touched`` read the state of the last finished batch and nothing
else. Reading merges the parts: sums by name, distinct documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.operators.resolve import keyed_mentions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGED = "resolved_id string, part int, added long"


class Tally(StatefulProcessor):
    """Adds mentions (entity_id, name, document_id, at) to their key's tallies."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "n long")
        self.documents = handle.getMapState("documents", "document_id string", "n long")
        self.seen = handle.getMapState("seen", "entity_id string", "at long")
        self.about = handle.getValueState("about", "normalized_key string, type string, category string, first_id string, first_at long, last_at long")

    def add(self, tally, counts: dict) -> None:
        for k, n in counts.items():
            key = (k,)
            tally.updateValue(key, ((tally.getValue(key)[0] if tally.containsKey(key) else 0) + int(n),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = 0
        for batch in rows:
            batch = batch.sort_values(["at", "document_id"], kind="stable").drop_duplicates("entity_id")
            batch = batch[[not self.seen.containsKey((i,)) for i in batch["entity_id"]]]
            if not len(batch):
                continue
            for i, at in zip(batch["entity_id"], batch["at"]):
                self.seen.updateValue((i,), (int(at),))
            self.add(self.names, batch["name"].value_counts().to_dict())
            self.add(self.documents, batch["document_id"].dropna().value_counts().to_dict())
            first = batch.loc[batch["entity_id"].idxmin()]
            new = (first["normalized_key"], first["type"], first["category"], first["entity_id"], int(batch["at"].min()), int(batch["at"].max()))
            old = self.about.get() if self.about.exists() else None
            if old is not None:
                lead = old if old[3] <= new[3] else new
                new = (*lead[:4], min(old[4], new[4]), max(old[5], new[5]))
            self.about.update(new)
            self.handle.registerTimer(int(batch["at"].max()) // 1000 + 1)
            added += len(batch)
        yield pd.DataFrame({"resolved_id": [key[0]], "part": [key[1]], "added": [added]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        for i in [i for i, at in self.seen.iterator() if at[0] // 1000 < past]:
            self.seen.removeKey(i)
        return iter(())

    def close(self) -> None:
        pass


class MaintainedResolver:
    """Entities of all mentions that streams into ``folder`` have brought. late: how
    far behind the latest time seen a mention may be and still count. Mentions
    without a time or an id are left out, for they can be neither late nor twice."""

    def __init__(self, spark: SparkSession, folder: str, late: str = "1 day", parts: int = 16, fold: bool = True, version: int = 1):
        self.spark, self.folder, self.late, self.parts, self.fold, self.version = spark, folder, late, parts, fold, version

    def start(self, mentions: DataFrame, time: str = "created_at", sink=None, **trigger) -> StreamingQuery:
        """Run a stream of mentions into the state; again with the same folder, it goes
        on where it ended. sink: for foreachBatch, takes the keys that a batch changed."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        own = mentions.where(F.col(time).isNotNull() & F.col("entity_id").isNotNull()).withWatermark(time, self.late)
        keyed = keyed_mentions(own, self.fold, self.version)
        rows = keyed.select(
            "resolved_id", F.pmod(F.xxhash64("entity_id"), F.lit(self.parts)).cast("int").alias("part"), "entity_id", F.coalesce("name", F.lit("")).alias("name"), "document_id",
            "normalized_key", "type", "category", F.unix_micros(F.col(time).cast("timestamp")).alias("at"), time)
        changed = rows.groupBy("resolved_id", "part").transformWithStateInPandas(Tally(), CHANGED, "Update", "EventTime")
        out = changed.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/progress").trigger(**(trigger or {"availableNow": True}))
        return (out.foreachBatch(sink) if sink else out.format("noop")).start()

    def state(self, of: str) -> DataFrame:
        """One of the tallies: (resolved_id, part, ...), a row for each entry."""
        found = self.spark.read.format("statestore").option("stateVarName", of).load(f"{self.folder}/progress")
        values = ["user_map_key.*", "user_map_value.*"] if "user_map_key" in found.columns else ["value.*"]
        return found.select("key.resolved_id", "key.part", *values)

    def entities(self, only: DataFrame | None = None) -> DataFrame:
        """The resolved entities, as ``resolve.resolved_entities`` has them, by state
        alone. only: of some (resolved_id)."""
        def of(name: str) -> DataFrame:
            found = self.state(name)
            return found if only is None else found.join(only.select("resolved_id").distinct(), "resolved_id", "left_semi")

        about = of("about").groupBy("resolved_id").agg(
            F.min("normalized_key").alias("normalized_key"), F.min_by("type", "first_id").alias("type"), F.min_by("category", "first_id").alias("category"),
            F.timestamp_micros(F.min("first_at")).alias("first_seen_at"), F.timestamp_micros(F.max("last_at")).alias("last_seen_at"))
        by_name = of("names").groupBy("resolved_id", "name").agg(F.sum("n").alias("n"))
        # mentions without a name count under an empty one, which is no name
        best = F.struct((F.col("name") == "").alias("none"), (-F.col("n")).alias("n"), (-F.length("name")).alias("l"), F.col("name").alias("name"))
        primary = by_name.groupBy("resolved_id").agg(F.min_by("name", best).alias("name"), F.sum("n").alias("mention_count"))
        docs = of("documents").groupBy("resolved_id").agg(F.count_distinct("document_id").alias("doc_count"))
        met = about.join(primary, "resolved_id", "left").join(docs, "resolved_id", "left")
        return met.select("resolved_id", F.coalesce("name", F.lit("")).alias("name"), "type", "category", "normalized_key", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "first_seen_at", "last_seen_at")


def closed_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by time window and type of a stream, each given once, when the watermark
    has passed the window's end; rows behind the watermark are dropped. For append mode."""
    own = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), kind, "n")
