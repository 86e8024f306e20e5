import math

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import queries, topk


def plain(rows, k=20):
    v = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.setdefault(i, []).append([math.floor(64 * float(np.float32(c))) for c in x])
    out = set()
    for q, vs in v.items():
        if q % 20:
            continue
        x = min(vs, key=lambda z: np.array(z, float).tobytes())
        s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, ys in v.items() if i != q for y in ys if len(y) == len(x))
        out |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])}
    return out


def run(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}


SCHEMA = "vec_id long, embedding array<float>, id string, v string, node string, kth string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "x", "x", "x", "x") for i, x in rows], SCHEMA)


def test_matches_plain_version(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "NODES", 5)
    rng = np.random.default_rng(1)
    c = rng.normal(size=(4, 6))
    rows = [(i, (c[i % 4] + rng.normal(size=6) * 0.1).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(90)]  # ties
    rows += [(2000, None), (2020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (None, [1.0] * 6), (2080, [1.0, 2.0]), (2081, [3.0, -1.0])]
    assert run(frame(spark, rows)) == plain(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [-1.0, 0.0]), (3, [0.0, 0.0])]
    assert run(frame(spark, rows)) == plain(rows)
    assert run(frame(spark, [(0, [1.0])])) == set()
    assert run(frame(spark, [])) == set()


def test_query_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op4_exact_top_k(spark, sf).collect()} == plain(rows)


def clustered(rng, clusters, each, dim, noise):
    c = rng.normal(size=(clusters, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return np.concatenate([x + rng.normal(size=(each, dim)) * noise for x in c])


def test_tree_is_a_cover_tree():
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(700, 8)), clustered(rng, 12, 60, 16, 0.02), np.ones((300, 4)), np.concatenate([np.zeros((200, 3)), rng.normal(size=(200, 3)) * np.logspace(0, 6, 200)[:, None]]), np.ones((1, 2))):
        t = topk.Tree(x)
        assert sorted(t.order) == list(range(len(x))) and (t.begin[0], t.end[0]) == (0, len(x))
        for n in range(len(t.begin)):
            at = t.points(n)
            assert np.linalg.norm(x[at] - t.cover.center[n], axis=1).max() <= t.cover.radius[n] + 1e-9
            kids = range(t.first[n], t.first[n] + t.kids[n])
            if not t.kids[n]:
                assert len(at) <= topk.LEAF or t.cover.radius[n] == 0
                continue
            assert sorted(i for c in kids for i in t.points(c)) == sorted(at)  # all points, once
            assert (t.cover.center[t.first[n]] == t.cover.center[n]).all()  # nested
            centers, reach = t.cover.center[list(kids)], t.cover.radius[list(kids)].max()
            apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)[np.triu_indices(len(centers), 1)]
            assert apart.min() >= reach - 1e-9  # separate
            assert all(t.cover.radius[c] <= t.cover.radius[n] / 2 + 1e-9 for c in kids) or t.kids[n] == topk.FAN


def test_no_inner_product_exceeds_its_bound():
    rng = np.random.default_rng(3)
    for x, y in ((rng.normal(size=(300, 5)) * 9, rng.normal(size=(400, 5)) - 2), (clustered(rng, 9, 40, 12, 0.1) * 64, clustered(rng, 9, 40, 12, 0.1) * 64), (np.zeros((80, 3)), rng.normal(size=(80, 3))), (-np.abs(rng.normal(size=(200, 4))), np.abs(rng.normal(size=(200, 4))))):
        q, d = topk.Tree(x), topk.Tree(y)
        a, b = (c.ravel() for c in np.indices((len(q.begin), len(d.begin))))
        u = topk.bounds(q.cover, a, d.cover, b)
        s = x @ y.T
        for i, j, top in zip(a.tolist(), b.tolist(), u.tolist()):
            assert s[np.ix_(q.points(i), d.points(j))].max() <= top


def metered(spark, x):
    meter = {}
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, meter=meter)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}
    return got, rows, {n: a.value for n, a in meter.items()}


def test_clusters_are_cut_off(spark):
    """Of 3,000 vectors in 50 clusters nine in ten products are never made."""
    got, rows, n = metered(spark, clustered(np.random.default_rng(4), 50, 60, 32, 0.02))
    assert got == plain(rows)
    assert n["nodes_cut"] >= 0.9 * n["nodes"] > 0 and n["products"] <= 0.1 * 150 * 3000


def test_nodes_of_a_block_are_cut(spark, monkeypatch):
    """One node at the top: the trees inside its block do the work."""
    monkeypatch.setattr(topk, "NODES", 1)
    got, rows, n = metered(spark, clustered(np.random.default_rng(5), 50, 60, 32, 0.02))
    assert got == plain(rows)
    assert n["pairs_cut"] >= 0.5 * n["pairs"] > 0 and n["products"] <= 0.3 * 150 * 3000


def test_vectors_without_structure_meet_every_row(spark, sf):
    """In 64 dimensions, without clusters, no bound cuts much: what remains is exact all the same."""
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    got, rows, n = metered(spark, x)
    assert got == plain(rows)
    print(n)
    assert n["products"] <= -(-len(x) // 20) * len(x)
