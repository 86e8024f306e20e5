"""Whitening of embeddings from an exact integer scatter.

Entries become integers, floor(scale * c) + offset. Tasks subtract a shift and sum
entries and products of entries without rounding: a block of rows is cut into
limbs of 20 bits, whose products over 4,096 rows are whole numbers below 2^53, so
that matrix products in doubles are exact; blocks are added up as Python integers.
A task's sums go out once, in limbs of 32 bits, as rows (i, j, limb, value) that
Spark adds up by key. From these the driver, which holds numbers of the dimensions
only, forms n * X'X - S S' exactly, divides by its trace into doubles and
decomposes by ``eigh``.

What is shuffled is one set of sums a task, d * d / 2 numbers, whatever the number
of vectors; the vectors themselves never are. Fitting, checking and applying are
three scans of one column.
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB, ROWS = 20, 4096
SUMS = "i int, j int, limb int, value long"


class Whitening(NamedTuple):
    n: int
    dim: int
    scale: int
    offset: int  # x = floor(scale * c) + offset
    shift: int  # subtracted from x before anything is summed
    sums: list[int]  # of x - shift
    directions: np.ndarray  # (dim, k), unit columns
    shares: np.ndarray  # (k,) eigenvalue / trace, falling
    spread: float  # square root of the trace


def is_whole(vector: Column) -> Column:
    """Not null, not empty, and all entries are finite numbers."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def entries(column: pa.Array, dim: int, scale: int, offset: int, shift: int) -> np.ndarray:
    """x - shift, (rows, dim): 64-bit integers, or Python integers where these are too small."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if len(v) == 0 or np.abs(v).max() * scale + abs(offset) + abs(shift) < 2.0**62:
        return np.floor(v * scale).astype(np.int64) + (offset - shift)
    return np.array([math.floor(Fraction(c) * scale) + offset - shift for c in v.ravel().tolist()], object).reshape(v.shape)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb[k] << 20 k, as doubles; only the last is negative anywhere."""
    out = []
    while True:
        if y.size == 0 or (-(1 << LIMB) <= y.min() and y.max() < 1 << LIMB):
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def scatter(y: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sums and sums of products over the rows of y, exact."""
    s, xx = 0, 0
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at:at + ROWS])
        for k, p in enumerate(parts):
            s = s + p.sum(axis=0).astype(np.int64).astype(object) * (1 << LIMB * k)
            for m, q in enumerate(parts):
                xx = xx + (p.T @ q).astype(np.int64).astype(object) * (1 << LIMB * (k + m))
    return s, xx


def as_rows(i: int, j: int, value: int):
    limb = 0
    while True:
        if -(1 << 31) <= value < 1 << 31:
            yield i, j, limb, value
            return
        yield i, j, limb, value & 0xFFFFFFFF
        value >>= 32
        limb += 1


def dominant(vectors: DataFrame, vector_col: str) -> int:
    """The length that most whole vectors have, the longer of equals; 0 if there are none."""
    v = F.col(vector_col)
    top = vectors.where(is_whole(v)).groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def whole(vectors: DataFrame, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col)
    return vectors.where(is_whole(v) & (F.size(v) == dim))


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, k: int = 32, shift: int | None = None) -> Whitening:
    """A whitening of x = floor(scale * c) + offset, fitted to all whole vectors of
    the most frequent length (the longer of equally frequent ones); others take no
    part. ``shift`` (the offset, if none is given) only keeps the products small: a
    covariance is the same with any. n = 0 where there are no such vectors."""
    shift = offset if shift is None else shift
    dim = dominant(vectors, vector_col)
    if not dim:
        return Whitening(0, 0, scale, offset, shift, [], np.zeros((0, 0)), np.zeros(0), 0.0)

    def run(batches):
        n, s, xx = 0, 0, 0
        for b in batches:
            y = entries(b.column(0), dim, scale, offset, shift)
            one, two = scatter(y)
            n, s, xx = n + len(y), s + one, xx + two
        if n:
            rows = [*as_rows(-1, -1, n)]
            for i in range(dim):
                rows += as_rows(-1, i, s[i])
                for j in range(i, dim):
                    rows += as_rows(i, j, xx[i, j])
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "value"])

    parts = whole(vectors, vector_col, dim).select(vector_col).mapInArrow(run, SUMS)
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():  # dim * dim / 2 numbers
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.value << 32 * r.limb)
    n = total[-1, -1]
    s = [total[-1, i] for i in range(dim)]
    v = {(i, j): n * total[i, j] - s[i] * s[j] for i in range(dim) for j in range(i, dim)}
    trace = sum(v[i, i] for i in range(dim))
    if not trace:
        top = min(k, dim)
        return Whitening(n, dim, scale, offset, shift, s, np.eye(dim)[:, :top], np.full(top, np.nan), 0.0)
    shares, directions = np.linalg.eigh(np.array([[v[min(i, j), max(i, j)] / trace for j in range(dim)] for i in range(dim)]))
    order = np.argsort(-shares, kind="stable")[:k]
    # trace is that of the covariance times n * n
    return Whitening(n, dim, scale, offset, shift, s, directions[:, order], shares[order], math.isqrt(trace << 128) / (n << 64))


def factors(model: Whitening) -> np.ndarray:
    """1 / sqrt(eigenvalue) of each component; NaN where there is no variance that doubles can tell from none."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(model.shares > model.dim * np.finfo(float).eps, 1 / (np.sqrt(model.shares) * model.spread), np.nan)


def applied(model: Whitening):
    """For a column of whole vectors: (whitened (rows, k), deviations as text)."""
    n, sums = model.n, model.sums
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the nearest integer to the mean
    rest = [s - n * m for s, m in zip(sums, middle)]
    small = max((abs(m) for m in middle), default=0) < 1 << 61
    left = np.array([r / n for r in rest])
    # a direction whose variance is zero is not used
    by = model.directions * np.nan_to_num(factors(model))

    def run(column: pa.Array):
        y = entries(column, model.dim, model.scale, model.offset, model.shift)
        if small and y.dtype != object:
            y = y - np.array(middle, np.int64)
        else:
            y = y.astype(object) - np.array(middle, object)
        most = int(max(abs(y.min()), abs(y.max()))) if y.size else 0
        d = y if (n * (most + 1)) ** 2 * model.dim < 1 << 62 and y.dtype != object else y.astype(object)
        d = d * n - np.array(rest, d.dtype)
        dev = (d * d).sum(axis=1)
        return (y.astype(np.float64) - left) @ by, list(map(str, dev.tolist()))

    return run


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The rows with a whole vector of the model's length, with ``whitened`` (array
    of doubles, one a component by falling eigenvalue; null for a component without
    variance) and ``deviation`` (decimal(38, 0): the sum over dimensions of
    (n * x - S)^2, exact; null if that has more digits).

    Rows whose vector is null, empty, of another length or holds a null or non-finite
    entry are left out. Null and repeated ids, repeated rows and nulls in other
    columns make no difference. Input columns of these two names, in any case, are
    replaced. A table without whole vectors gives an empty one.
    """
    other = [c for c in vectors.columns if c.lower() not in ("whitened", "deviation")]
    none = np.isnan(factors(model)).tolist()

    def run(batches):
        act = applied(model)
        for b in batches:
            w, dev = act(b.column("vector"))
            flat = pa.array(w.ravel(), mask=np.tile(np.array(none), len(w))) if len(none) else pa.array([], pa.float64())
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("row"), arrays, pa.array(dev, pa.string())], ["row", "whitened", "dev"])

    row = F.struct(*[F.col(f"`{c}`") for c in other])
    dealt = whole(vectors, vector_col, model.dim).select(row.alias("row"), F.col(vector_col).alias("vector"))
    schema = dealt.select("row").schema.add("whitened", T.ArrayType(T.DoubleType())).add("dev", "string")
    done = dealt.mapInArrow(run, schema) if model.n else dealt.sparkSession.createDataFrame([], schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in other], "whitened", F.expr("try_cast(dev AS decimal(38, 0))").alias("deviation"))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """The largest entry, without sign, of the covariance of the whitened vectors
    minus the identity, over components with variance; None if there are none. A
    second scan, which whitens the rows (about the exact mean) and sums products."""
    keep = ~np.isnan(factors(model))
    k = int(keep.sum())
    if not k:
        return None

    def run(batches):
        act = applied(model)
        s, ww = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = act(b.column(0))[0][:, keep]
            s, ww = s + w.sum(axis=0), ww + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * k + i.tolist(), pa.int32()), pa.array([*range(k)] + j.tolist(), pa.int32()), pa.array(np.concatenate([s, ww[i, j]]))], ["i", "j", "value"])

    parts = whole(vectors, vector_col, model.dim).select(vector_col).mapInArrow(run, "i int, j int, value double")
    got = {(r.i, r.j): r.value / model.n for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}  # k * k / 2 numbers
    return max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(k) for j in range(i, k))


def whitened_components(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", k: int = 32) -> DataFrame:
    """One row for each whole vector and component: (id, component from 1, n,
    deviation, whitened, explained, identity_error). deviation is a long, null where
    that is too small for it; components without variance have no whitened value and
    explain 0 (or null, if nothing varies)."""
    model = fit(vectors, vector_col, k=k)
    error = identity_error(vectors, model, vector_col) if model.n else None
    shares = F.array(*[F.lit(None if math.isnan(x) else max(x, 0.0)).cast("double") for x in model.shares.tolist()])
    done = whiten(vectors.select(id_col, vector_col), model, vector_col)
    rows = done.select(id_col, F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares.cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
