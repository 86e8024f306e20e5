import itertools
import random

import numpy as np

import corpus_pipeline
from weftline.llm import jaccard, queries, simhash


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_left(texts):
    """Ids that stay: the least of each component of pairs at 0.8 or more."""
    s = plain_sets(texts)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if s[a] == s[b] or both >= 0.8 * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in s if root[i] == i}


def copies(n, words, edits, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{rng.random()}"
        out[i] = " ".join(w)
    return out


def left(df):
    return {r.doc_id for r in df.collect()}


def test_pipeline_stage_takes_every_pair_at_eight_tenths(spark, sf):
    docs = queries.documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert left(corpus_pipeline.drop_near_copies(spark, docs, sf)) == plain_left(texts)


def test_fingerprints_find_candidates_too(spark):
    """Pairs without a MinHash key in common are found if op10 links them, and their sets decide."""
    long = [f"w{i}" for i in range(3000)]
    texts = {1: " ".join(long), 2: " ".join(long[:-1]), 3: "some other text", 4: " ".join([*long, "x"]), 5: "one more"}
    made = {i: jaccard.shingles(t.encode()) for i, t in texts.items()}
    fp = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()} | {5: simhash.fingerprint(texts[3].encode()) ^ 1}
    assert all((fp[1] ^ fp[i]).bit_count() <= simhash.MAX_BITS for i in (2, 4))
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    distinct = spark.createDataFrame([(signed(k), i, len(s), [100 * i + j for j in range(3)], signed(fp[i])) for i, (k, s) in made.items()], "key long, first long, size long, bands array<long>, fp long")
    rows = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "id long, t binary")
    found = {frozenset((r.a, r.b)) for r in jaccard.links(distinct, rows, 0.8).collect()}
    of = {signed(k): i for i, (k, _) in made.items()}
    assert len(found) == 2 and {of[k] for pair in found for k in pair} == {1, 2, 4}


def test_sets_are_made_of_needed_texts_only(docs):
    some = docs([(i, f"text {i}") for i in (7, -3, 10**12)]).selectExpr("doc_id")
    rows = docs([(i, f"text {i}") for i in (*range(-5, 400), 10**12)]).selectExpr("doc_id as id", "cast(text as binary) as t")
    got = {r.id for r in rows.mapInArrow(jaccard.sets(jaccard.needed(some)), "id long, key long, set binary").collect()}
    assert got >= {7, -3, 10**12} and len(got) < 20


def test_small_and_large_buckets(docs, monkeypatch):
    texts = {**copies(40, 100, 8), **{100 + i: t for i, t in copies(30, 60, 4, 2).items()}, 200: "one", 201: "ONE", 202: "one two three", 203: "", 204: " \n"}
    want = plain_left(texts)
    assert len(want) < len(texts)
    assert left(jaccard.one_of_each(docs(list(texts.items())))) == want
    monkeypatch.setattr(jaccard, "SMALL", 3)
    assert left(jaccard.one_of_each(docs(list(texts.items())))) == want


def test_edge_cases(docs, clashing):
    assert left(jaccard.one_of_each(docs([]))) == set()
    got = [r.doc_id for r in jaccard.one_of_each(clashing([(1, "a b"), (1, "a b"), (2, "A  b"), (None, "a b"), (3, None)])).collect()]
    assert sorted(got, key=lambda i: i or 0) == [None, 1, 1, 3]


def plain_forest(found, least):
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        if jaccard.similarity(found[i], found[j]) >= least:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(found))]


def test_a_forest_connects_what_is_similar():
    rng = random.Random(7)
    for n, small in itertools.product((1, 2, 5, 60), (0, 3, 100)):
        found = []
        for _ in range(n):
            base = set(range(rng.choice((0, 300, 900)), 1000, rng.choice((3, 7))))
            found.append(np.array(sorted(x for x in base if rng.random() > 0.12), np.uint64))
        found += [np.empty(0, np.uint64)] * 2
        got = jaccard.forest(found, 0.8, small)
        assert len(got) < len(found) and all(jaccard.similarity(found[i], found[j]) >= 0.8 for i, j in got)
        root = list(range(len(found)))
        for i, j in got:
            root = [root[i] if r == root[j] else r for r in root]
        want = plain_forest(found, 0.8)
        assert len(set(root)) == len(set(want)) and len(set(zip(root, want))) == len(set(want))


def test_buckets_cut_into_blocks(docs, monkeypatch):
    texts = {**copies(60, 80, 9, 5), **{100 + i: t for i, t in copies(20, 60, 4, 6).items()}}
    want = plain_left(texts)
    assert 20 < len(want) < len(texts)
    monkeypatch.setattr(jaccard, "ELEMENTS", 500)
    assert left(jaccard.one_of_each(docs(list(texts.items())))) == want
