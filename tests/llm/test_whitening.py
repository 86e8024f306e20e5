import math
import random
from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import queries
from weftline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=32):
    """Exact sums as fractions of Python integers."""
    good = [(i, [math.floor(64 * Fraction(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x, n, d = [v for _, v in good], len(good), len(good[0][1])
    s = [sum(v[i] for v in x) for i in range(d)]
    cov = [[Fraction(n * sum(v[i] * v[j] for v in x) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    dev = {}
    for i, v in good:
        dev.setdefault(i, []).append(sum((n * c - t) ** 2 for c, t in zip(v, s)))
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    order = np.argsort(-e)[:k]
    centred = np.array([[float(c - Fraction(t, n)) for c, t in zip(v, s)] for v in x])
    trace = float(sum(cov[i][i] for i in range(d)))
    return n, dev, centred @ u[:, order] / np.sqrt(e[order]), e[order] / trace, [i for i, _ in good]


def table(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(3)


def compare(df, rows, k=32):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    n, dev, white, shares, ids = plain(rows, k)
    assert sorted(got) == sorted(ids)
    mine = np.array([[got[i][c + 1].whitened for c in range(white.shape[1])] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine, white * sign, rtol=1e-8, atol=1e-8)
    for i in ids:
        for c, r in got[i].items():
            assert r.n == n and [r.deviation] == dev[i] and r.explained == pytest.approx(shares[c - 1], rel=1e-9) and r.identity_error < 1e-8


def test_exact_sums_of_any_size():
    rng = random.Random(3)
    for size in (5, 1 << 19, 1 << 21, 1 << 40, 1 << 61, 1 << 90, 1 << 300):
        y = [[rng.randint(-size, size) for _ in range(4)] for _ in range(50)]
        s, xx = W.scatter(np.array(y, np.int64 if size < 1 << 62 else object))
        assert list(s) == [sum(v[i] for v in y) for i in range(4)]
        assert xx.tolist() == [[sum(v[i] * v[j] for v in y) for j in range(4)] for i in range(4)]
    for value in (0, -1, 5, 1 << 31, -(1 << 31), -(1 << 31) - 1, 1 << 200, -(1 << 200) + 7):
        assert sum(v << 32 * limb for _, _, limb, v in W.as_rows(0, 0, value)) == value


def test_against_exact_version(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix + [0, 1e6, -3, 0, 1e4, 0]).tolist()) for i in range(300)]
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [math.nan] * 6), (905, [1.0, math.inf, 1.0, 1.0, 1.0, 1.0])]
    compare(W.whitened_components(table(spark, rows + bad)), rows)


def test_any_shift_gives_the_same(spark):
    rows = [(i, [float(i % 7), float(i * i % 11), 0.3 * i]) for i in range(60)]
    one, two = W.fit(table(spark, rows)), W.fit(table(spark, rows), shift=-(1 << 70))
    assert np.array_equal(one.shares, two.shares) and one.spread == two.spread
    compare(W.whitened_components(table(spark, rows)), rows)
    a, b = ({r.vec_id: r for r in W.whiten(table(spark, rows), m).collect()} for m in (one, two))
    assert all(a[i].deviation == b[i].deviation and np.allclose(a[i].whitened, b[i].whitened, atol=1e-9) for i in a)


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 1e200).tolist()) for i in range(40)]
    model = W.fit(table(spark, rows))
    assert W.identity_error(table(spark, rows), model) < 1e-8
    out = W.whiten(table(spark, rows), model).collect()
    assert all(r.deviation is None and len(r.whitened) == 3 for r in out)  # over 38 digits
    y = [[math.floor(64 * Fraction(c)) for c in v] for _, v in rows]
    assert model.sums == [sum(v[i] for v in y) for i in range(3)]


def test_repeats_ties_and_no_variance(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [2.0, 4.0, 5.0])]
    out = W.whitened_components(table(spark, rows)).collect()
    assert len(out) == 9
    by = {(r.vec_id, r.component): r for r in out}
    assert abs(by[1, 1].whitened) == pytest.approx(1 / math.sqrt(2)) and by[1, 1].explained == pytest.approx(1) and by[1, 1].deviation == 64**2 * 5
    assert by[None, 2].whitened is None and by[None, 2].explained == pytest.approx(0, abs=1e-12) and by[1, 1].identity_error < 1e-12
    one = W.whitened_components(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2


def test_empty_and_clashing(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = W.whitened_components(table(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(i, [float(i), float(i * i)]) for i in range(5)]
    df = table(spark, rows).selectExpr("*", "'x' as row", "'y' as WHITENED", "'z' as vector", "'q' as dev")
    out = W.whiten(df, W.fit(df)).collect()
    assert [(r.row, r.vector, r.dev, len(r.whitened)) for r in out] == [("x", "z", "q", 2)] * 5


def test_query_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op12_whitening(spark, sf), rows)
