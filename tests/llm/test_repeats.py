import hashlib

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import queries, repeats


def plain(rows, window=50):
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = (t or "").encode().split()
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, ws in words.items():
        stay = [True] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k:k + window])] < i:
                stay[k:k + window] = [False] * window
        kept = b" ".join(w for w, s in zip(ws, stay) if s)
        out[i] = (len(ws), len(ws) - sum(stay), hashlib.sha256(kept).hexdigest())
    return out


def run(df, window=50):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, window).collect()}


def test_winnowing_files_equal_windows_alike():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50, 200).astype(np.uint64)
    a, lo, hi = repeats.filed(np.concatenate([rng.integers(0, 50, 77).astype(np.uint64), passage]), 50)
    b, lo2, hi2 = repeats.filed(passage, 50)
    of = {w: p for p, x, y in zip(a, lo, hi) for w in range(x, y + 1)}
    for p, x, y in zip(b, lo2, hi2):
        for w in range(x, y + 1):
            assert of[w + 77] == p


def passages():
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 400)}"
    p = [[word() for _ in range(n)] for n in (49, 50, 51, 90, 400)]
    rows = []
    for i in range(60):
        t = [f"own{i}_{k}" for k in range(int(rng.integers(0, 30)))]
        for k in rng.integers(0, 5, int(rng.integers(0, 4))):
            cut = int(rng.integers(0, 3))
            t += p[k][cut:] + [f"gap{i}"]
        rows.append((i, " ".join(t)))
    return rows


def test_matches_plain_version(clashing):
    rows = passages() + [(100, None), (101, ""), (102, " \t\n"), (103, "x " * 30_000), (104, "x " * 120), (105, passages()[7][1]), (106, passages()[7][1])]
    assert run(clashing(rows)) == plain(rows)


def test_hot_phrase_over_several_shards(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 3)
    rows = passages()
    assert run(docs(rows)) == plain(rows)


def test_one_phrase_of_very_many_windows(spark, docs):
    """A phrase in 2,600 different contexts, each in two documents: no automaton
    outgrows its bound, and the result is the plain one."""
    rng = np.random.default_rng(3)
    tries = rng.integers(0, 1 << 60, 160_000).astype(np.uint64)
    h = repeats.stretch_hashes(repeats.word_hashes([b"p%d" % x for x in tries.tolist()]), repeats.PHRASE)
    at = int(h.argmin())  # so low that every window with it is filed under it
    phrase = [f"p{x}" for x in tries[at:at + repeats.PHRASE].tolist()]
    rows = []
    for k in range(2600):
        body = [f"a{k}_{j}" for j in range(42)] + phrase + [f"b{k}_{j}" for j in range(42)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, f"other{k} " + " ".join(body))]
    df = docs(rows)
    found = repeats.written(repeats.profile(df, 50, "doc_id", "text"), "profile")
    _, dealt = repeats.dealt_stretches(df, found, 50, "doc_id", "text")
    sizes = [r.n for r in dealt.where("kind = 0").groupBy("shard").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")) - 49).alias("n")).collect()]
    assert sum(sizes) >= 100_000 and max(sizes) <= repeats.SHARD_WINDOWS and len(sizes) > 10
    assert run(df) == plain(rows)


def test_passages_of_a_hot_phrase_are_copied_by_all_tasks(spark, docs, monkeypatch):
    """A license in 3,000 texts: its first document sends each passage once, copies
    are made by many tasks, and every shard has every passage."""
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "COPIES", 16)
    license = " ".join(f"l{i}" for i in range(80))
    df = docs([(i, f"u{i} {license} v{i}") for i in range(3000)])
    found = repeats.written(repeats.profile(df, 50, "doc_id", "text"), "profile")
    _, dealt = repeats.dealt_stretches(df, found, 50, "doc_id", "text")
    sent = dealt.where("kind = 0").withColumn("task", F.spark_partition_id())
    assert [r.id for r in sent.select("id").distinct().collect()] == [0]
    per = [r["count"] for r in sent.groupBy("at").count().collect()]
    assert per and set(per) == {750}
    by_task = [r["count"] for r in sent.groupBy("task").count().collect()]
    assert len(by_task) > 3 and max(by_task) < 0.5 * sum(by_task)
    assert all(r.n_removed == (80 if r.doc_id else 0) for r in repeats.remove_repeats(df).collect())


def test_repeated_and_missing_ids(docs):
    t = " ".join(f"w{i}" for i in range(60))
    got = repeats.remove_repeats(docs([(1, t), (1, t), (2, t + " more"), (None, t)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 60, 0), (1, 60, 0), (2, 61, 60)]
    assert [r.kept for r in got if r.doc_id == 2] == ["more"]
    assert repeats.remove_repeats(docs([])).collect() == []


def test_query_on_whole_table(spark, sf):
    want = plain([(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, sf).collect()} == want


def test_many_phrases_share_an_automaton(spark, docs, monkeypatch):
    """900 passages of 70 words, each in two documents: their phrases, several
    thousand, lie in a bounded number of shards, and the result is the plain one, also
    where a shard needs several automata."""
    rows = []
    for k in range(900):
        body = " ".join(f"s{k}_{j}" for j in range(70))
        rows += [(2 * k, f"left{k} {body}"), (2 * k + 1, f"{body} right{k}")]
    df = docs(rows)
    found = repeats.written(repeats.profile(df, 50, "doc_id", "text"), "profile")
    _, dealt = repeats.dealt_stretches(df, found, 50, "doc_id", "text")
    shards = [r["count"] for r in dealt.where("kind = 0").groupBy("shard").count().collect()]
    assert len(shards) <= 16 * repeats.width(spark) and sum(shards) > 5 * len(shards)
    want = plain(rows)
    assert run(df) == want
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 50)
    full = repeats.Machine(50)
    full.add([b"w%d" % i for i in range(60)], 1)
    assert full.full(40, 50) and not full.full(39, 50) and not repeats.Machine(50).full(99, 50)
    assert run(df) == want
