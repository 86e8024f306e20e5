"""Streams that keep state: duplicates, late rows, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.operators import resolve
from weftline.schemas import MENTIONS
from weftline.streaming.state import MaintainedResolver, closed_windows

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def mention(i, name, day, doc="d0"):
    return (f"e{i:03}", name, "person", "c", doc, 0, START + day * DAY if day is not None else None)


def stream(spark, folder, rows):
    spark.createDataFrame(rows, MENTIONS).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MENTIONS).parquet(folder)


def entities(df):
    return sorted((r.resolved_id, r.name, r.type, r.category, r.normalized_key, r.mention_count, r.doc_count, r.first_seen_at, r.last_seen_at) for r in df.collect())


def test_state_equals_the_batch(spark, tmp_path):
    own, files = MaintainedResolver(spark, str(tmp_path / "s"), late="2 days", parts=4), str(tmp_path / "in")
    changed = []

    def sink(batch, _):
        changed.append({r.resolved_id for r in batch.where("added > 0").collect()})

    one = [mention(i, ["Ada", "ADA", "Dr. Ada", "Bob", None][i % 5], i % 10, f"d{i % 3}") for i in range(60)]
    own.start(stream(spark, files, one + one[:7]), sink=sink).awaitTermination()
    assert entities(own.entities()) == entities(resolve.resolved_entities(spark.createDataFrame(one, MENTIONS)))

    again = [m for m in one if m[6] >= START + 8 * DAY]  # twice, and not late
    late = [mention(900 + i, "Eve", 3) for i in range(5)] + [m for m in one if m[6] < START + 6 * DAY]
    new = [mention(100 + i, "Cleo" if i % 2 else "Ada", 12, "d7") for i in range(6)] + [mention(200, "Zoe", None), (None, "Zoe", "person", "c", "d", 0, START + 12 * DAY)]
    restarted = MaintainedResolver(spark, str(tmp_path / "s"), late="2 days", parts=4)
    restarted.start(stream(spark, files, again + late + new), sink=sink).awaitTermination()
    kept = [m for m in one + new if m[0] and m[6]]
    assert entities(restarted.entities()) == entities(resolve.resolved_entities(spark.createDataFrame(kept, MENTIONS)))
    keys = {r.resolved_id for r in resolve.keyed_mentions(spark.createDataFrame([m for m in new if m[0] and m[6]], MENTIONS)).collect()}
    assert set().union(*changed[1:]) >= keys and not any("eve" in e[4] for e in entities(restarted.entities()))

    # ids behind the watermark are forgotten, tallies stay; an empty run changes nothing
    last = [mention(300, "Ada", 40)]
    restarted.start(stream(spark, files, last)).awaitTermination()
    restarted.start(stream(spark, files, [mention(301, "Ada", 41)])).awaitTermination()
    assert {r.entity_id for r in restarted.state("seen").collect()} <= {"e300", "e301"}
    some = resolve.keyed_mentions(spark.createDataFrame(last, MENTIONS))
    (ada,) = restarted.entities(only=some).collect()
    assert (ada.normalized_key, ada.mention_count) == ("person|ada", 36 + 3 + 2)


def test_a_hot_entity_is_spread_over_parts(spark, tmp_path):
    own = MaintainedResolver(spark, str(tmp_path / "s"), parts=8)
    own.start(stream(spark, str(tmp_path / "in"), [mention(i, "Ada", 1, f"d{i}") for i in range(400)])).awaitTermination()
    (ada,) = own.entities().collect()
    assert (ada.mention_count, ada.doc_count) == (400, 400)
    parts = own.state("names").groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert len(parts) == 8 and max(r.n for r in parts) < 100


def test_windows_are_given_once_and_late_rows_dropped(spark, tmp_path):
    schema, files, got = "ts timestamp, event_type string", str(tmp_path / "in"), []

    def run(rows):
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(files)
        df = closed_windows(spark.readStream.schema(schema).parquet(files))
        df.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()

    hour = dt.timedelta(hours=1)
    run([(START + k * hour / 2, "a") for k in range(10)])
    run([(START, "a"), (START + 4.6 * hour, "a"), (START + 9 * hour, "b")])  # the first is late
    assert sorted(got) == [(START + k * hour, "a", 3 if k == 4 else 2) for k in range(5)]
