"""Tables that several writers change."""

import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources.tables import AppendedTable, CommitLog, Lost, TableSet, VersionedTable


def frame(spark, ids, v="a"):
    return spark.createDataFrame([(i, v) for i in ids], "k int, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_number_is_made_once(spark, tmp_path):
    log, made = CommitLog(spark, str(tmp_path / "l")), []
    threads = [threading.Thread(target=lambda i=i: made.append(CommitLog(spark, str(tmp_path / "l")).claim(1, {"i": i}))) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(made) == [False] * 7 + [True] and log.numbers() == [1] and set(log.newest()[1]) == {"i"}


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.upsert(frame(spark, range(5)), ["k"])
    real, looked = two.tables.log.newest, []

    def newest():  # the second looks before the first has written
        found = real()
        if not looked:
            looked.append(1)
            one.upsert(frame(spark, (100, 101), "one"), ["k"])
        return found

    two.tables.log.newest = newest
    two.upsert(frame(spark, (200, 100), "two"), ["k"])
    assert rows(one.read()) == sorted([(i, "a") for i in range(5)] + [(100, "two"), (101, "one"), (200, "two")])


def test_threads_lose_nothing(spark, tmp_path):
    def run(i):
        VersionedTable(spark, str(tmp_path / "t")).upsert(frame(spark, (i, 50), str(i)), ["k"])

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    got = dict(rows(VersionedTable(spark, str(tmp_path / "t")).read()))
    assert {k: got[k] for k in range(4)} == {k: str(k) for k in range(4)} and len(got) == 5


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "g"))
    t.write({"nodes": frame(spark, (1, 2)), "edges": frame(spark, (7,))})
    before = t.read()

    def fails(tables):
        out = {"nodes": t.written(frame(spark, (3,)))}
        raise OSError("disk") if out else None

    with pytest.raises(OSError):
        t.commit(fails)
    assert rows(t.read()["nodes"]) == [(1, "a"), (2, "a")] and t.versions() == [1]
    t.upsert({"nodes": (frame(spark, (2, 3), "b"), ["k"]), "edges": (frame(spark, (8,)), ["k"])})
    assert rows(t.read()["nodes"]) == [(1, "a"), (2, "b"), (3, "b")] and rows(t.read()["edges"]) == [(7, "a"), (8, "a")]
    assert rows(before["nodes"]) == [(1, "a"), (2, "a")]  # a reader keeps what it began with
    t.change(lambda f: {"edges": f["edges"].join(f["nodes"].withColumn("k", F.col("k") + 5), "k", "left_semi")})
    assert rows(t.read()["edges"]) == [(7, "a"), (8, "a")]
    always = t.log.claim
    t.log.claim = lambda *_: False
    with pytest.raises(Lost):
        t.change(lambda f: {"edges": f["edges"]})
    t.log.claim = always


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.upsert(frame(spark, range(1000)), ["k"])
    old = t.tables.record()["rows"]["parts"]
    t.upsert(frame(spark, (3, 2000), "new").withColumn("w", F.lit(1)), ["k"])
    new = t.tables.record()["rows"]["parts"]
    assert sum(new[b] != old[b] for b in old) <= 2 and t.read().count() == 1001
    assert rows(t.read().where("k in (3, 4)")) == [(3, "new", 1), (4, "a", None)]
    assert t.delete(lambda df: df.where("k <> 3")) == 3 and t.read().count() == 1000 and len(t.tables.record()["rows"]["parts"]) == 64
    assert VersionedTable(spark, str(tmp_path / "none")).delete_document("d") is None


def test_files_go_by_age(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(4):
        t.write(frame(spark, (i,)))
    assert t.versions() == [3, 4] and len(list((tmp_path / "t" / "data").iterdir())) == 4
    t.tables.cleaned(1, grace=-10)
    assert t.versions() == [4] and len(list((tmp_path / "t" / "data").iterdir())) == 1 and rows(t.read()) == [(3, "a")]


def test_an_appended_table_stays_one_scan(spark, tmp_path):
    t = AppendedTable(spark, str(tmp_path / "a"), "k")
    t.MERGE = 4
    for i in range(18):
        t.append(frame(spark, range(i, i + 3)))
    assert rows(t.read()) == [(i, "a") for i in range(20)] and len(t.batches()) <= 3 * 3
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    t.append(frame(spark, (5, 90)).withColumn("more", F.lit(1)))
    assert t.read().where("k = 90").head().more == 1 and t.read().count() == 21


def test_two_appending_writers(spark, tmp_path):
    one, two = (AppendedTable(spark, str(tmp_path / "a"), "k") for _ in range(2))
    one.append(frame(spark, (1,)))
    real, looked = two.tables.log.newest, []

    def newest():
        found = real()
        if not looked:
            looked.append(1)
            one.append(frame(spark, (2, 3)))
        return found

    two.tables.log.newest = newest
    two.append(frame(spark, (3, 4)))
    assert rows(two.read()) == [(i, "a") for i in (1, 2, 3, 4)]
