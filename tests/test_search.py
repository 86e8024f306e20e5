import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import search, store

SCHEMA = "label string, document_id string"


def made(spark, seed, n):
    rng = random.Random(seed)
    return spark.createDataFrame([("".join(rng.choices("abcé🔑 \n", k=rng.randint(0, 12))) if rng.random() > 0.05 else None, f"d{rng.randint(0, 4)}") for _ in range(n)], SCHEMA)


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=8)
    with pytest.raises(LookupError):
        index.search("abc")
    one, two = made(spark, 1, 150), made(spark, 2, 150)
    index.add(one)
    index.add(two.unionAll(one.limit(20)))
    every = one.unionAll(two).unionAll(one.limit(20))
    some = [r.label for r in one.where("length(label) > 5").limit(4).collect()]
    for q in ("abc", "ABC", "cab", "é🔑a", "a", "", "no such thing", some[0], some[1][1:5], some[2][:3].upper(), " \na"):
        assert sorted(index.search(q).collect()) == sorted(every.where(store.contains("label", q)).collect()), q
    got = [(r.name, r.documents) for r in search.entities_found(index, "ab", 5).collect()]
    assert got == [(r.name, r.documents) for r in store.search_entities(every, "ab", 5).collect()]


def test_only_the_folders_of_the_query_are_read(spark, tmp_path):
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=32)
    index.add(made(spark, 3, 300))
    plan = index.postings(["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]
    read = {r[0] for r in index.postings(["abc"]).select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1


def test_a_frequent_trigram_has_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 50)
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["src", "dst"], buckets=4)
    index.add(spark.createDataFrame([(f"node:{i}", f"x{i}") for i in range(400)], "src string, dst string"))
    blocks = [r.n for r in index.postings(["ode"]).collect()]
    assert sum(blocks) == 400 and len(blocks) >= 8 and max(blocks) < 100
    assert {r.src for r in index.search("x39").collect()} == {f"node:{i}" for i in (39, *range(390, 400))}
    long = "ab" * 40_000 + "needle"
    index.add(spark.createDataFrame([(long, "y")], "src string, dst string"))
    assert [r.dst for r in index.search("bneed").collect()] == ["y"]


def test_merged_batches_find_the_same(spark, tmp_path):
    """Many batches become few, large ones stay as they are, nothing is lost or comes
    twice, and a text known from a merged batch gets no second posting."""
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=4)
    every, batches = None, [made(spark, 10, 3000)] + [made(spark, k, 40) for k in range(11, 16)]
    for b in batches:
        index.add(b)
        every = b if every is None else every.unionAll(b)
    before = index.tables.record()
    version = index.merge()
    after = index.tables.record()
    for name in ("rows", "postings"):
        assert len(before[name]["parts"]) == 6 and len(after[name]["parts"]) == 2
        assert len(set(before[name]["parts"]) & set(after[name]["parts"])) == 1  # the large one
    index.add(batches[2])
    every = every.unionAll(batches[2])
    assert index.merge(share=1e9) == version + 2 and {len(e["parts"]) for e in index.tables.record().values()} == {1}
    assert index.merge(share=1e9) == version + 2
    ids = index.postings(["abc", "cab", "bbb"]).select("gram", F.explode("ids"))
    assert ids.count() == ids.distinct().count() > 0
    for q in ("abc", "cAb", "é🔑a", "a", "no such thing"):
        assert sorted(index.search(q).collect(), key=str) == sorted(every.where(store.contains("label", q)).collect(), key=str), q


def test_a_merge_and_an_addition_at_once(spark, tmp_path, monkeypatch):
    """A batch that is added while others are merged stays; the merge runs again."""
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=4)
    every = made(spark, 1, 50).unionAll(made(spark, 2, 50))
    index.add(made(spark, 1, 50))
    index.add(made(spark, 2, 50))
    other, small, ran = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=4), index._small, []

    def slow(parts, share):
        if not ran:
            ran.append(other.add(spark.createDataFrame([("needle in between", "d")], SCHEMA)))
        return small(parts, share)

    monkeypatch.setattr(index, "_small", slow)
    index.merge(share=1e9)
    assert [r.label for r in index.search("needle").collect()] == ["needle in between"]
    assert index.search("").count() == every.where("label is not null").count() + 1


def test_postings_go_by_blocks(spark, tmp_path, monkeypatch):
    """A trigram of many texts is a short row a block, not a row a text, and blocks find all that a scan finds;
    astral signs, equal texts, long texts in pieces and texts of known batches included."""
    monkeypatch.setattr(search, "BLOCK_CHARS", 1000)
    index = search.TrigramIndex(spark, str(tmp_path / "i"), ["label"], buckets=4)
    long = "xyz🔑" * 700 + "w🔑🔑v"
    one = made(spark, 21, 400).unionAll(spark.createDataFrame([(long, "d"), (long, "d"), ("same text", "d"), ("same text", "e")], SCHEMA))
    index.add(one)
    index.add(one.limit(50).unionAll(made(spark, 22, 300)))
    every = one.unionAll(one.limit(50)).unionAll(made(spark, 22, 300))
    stored = index._stored(index.tables.record(), "postings")
    assert dict(stored.dtypes)["places"] == "array<smallint>" and "_text" not in index._stored(index.tables.record(), "rows").columns
    assert stored.where("gram = 'abc'").count() < index.postings(["abc"]).agg(F.sum("n")).head()[0]
    assert stored.where("gram = ''").agg(F.sum(F.size("texts"))).head()[0] == every.where("length(label) > 2").select(F.lower("label")).distinct().count()
    for q in ("abc", "🔑🔑v", "z🔑x", "same text", "🔑ab"):
        assert sorted(index.search(q).collect()) == sorted(every.where(store.contains("label", q)).collect()), q
