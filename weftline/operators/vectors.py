"""Similar vectors by cosine: random-hyperplane hashing with multi-probe finds the
pairs to compare, an exact cosine decides.

A table of the index is ``bits`` hyperplanes; a vector lies in the bucket of the
sides it is on, and is looked for there and in the buckets that its least certain
sides would give (query-directed probes). How many tables a recall takes is
worked out beforehand, by drawing pairs at the least similarity asked for. Buckets
are join keys; one that holds very many vectors is split. Equal vectors are one
before any of this. ``exact_pairs`` compares all, block by block, as the truth.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .iterate import kept
from .similar import SPLIT, parted

#: Probes flip some of so many least certain sides.
UNSURE = 6
#: Rows of a block, and pairs of a product, of the comparison of all.
BLOCK, PRODUCTS = 16_384, 1 << 22
SETS = np.array(sorted(itertools.product((0, 1), repeat=UNSURE), key=sum))


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit(vectors: pd.Series) -> pd.Series:
    """Unit vectors; divided by their largest entry first, so that no size overflows."""
    def one(v):
        v = v / np.abs(v).max()
        return v / math.sqrt(v @ v)

    return vectors.map(one)


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vector) -> (id, root): equal vectors have one root, the least id; and
    (root, vector) with unit vectors of doubles. Vectors that are null, all zero or
    hold a null or non-finite entry are left out."""
    own = vectors.where(usable(F.col("vector")) & F.col("id").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    own = own.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("second"), "vector"))
    roots = kept(own.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "vector"), "id").alias("x")).select("h1", "h2", F.col("x.id").alias("root"), F.col("x.vector").alias("vector")), "roots")
    classes = own.select("id", "h1", "h2").join(roots.select("h1", "h2", "root"), ["h1", "h2"]).select("id", "root")
    return classes, roots.select("root", unit("vector").alias("vector"))


def probes(margins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signed distances to hyperplanes (rows, bits): each row's bucket, and the n
    likeliest buckets of a near vector (its own first)."""
    bits = margins.shape[1]
    value = np.int64(1) << np.arange(bits, dtype=np.int64)
    own = (margins > 0) @ value
    few = min(UNSURE, bits)
    at = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :few]
    sets = np.unique(SETS[:, :few], axis=0)
    cost = np.take_along_axis(margins, at, 1) ** 2 @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :min(n, len(sets))]
    flips = value[at] @ sets.T
    return own, own[:, None] ^ np.take_along_axis(flips, best, 1)


def meeting(cosine: float, bits: int, n_probes: int, draws: int = 20_000, seed: int = 1) -> float:
    """The chance that two vectors of a cosine meet in one table, from drawn pairs."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, draws, bits))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    (a, pa_), (b, pb) = probes(x, n_probes), probes(y, n_probes)
    return float(((pb == a[:, None]).any(axis=1) | (pa_ == b[:, None]).any(axis=1)).mean())


def tables_for(cosine: float, bits: int, n_probes: int, recall: float, most: int = 512) -> int:
    """Tables in which two vectors of a cosine meet once with a chance of ``recall``."""
    hit = meeting(cosine, bits, n_probes)
    if hit >= recall:
        return 1
    n = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit else most + 1
    if n > most:
        raise ValueError(f"{bits} bits and {n_probes} probes need over {most} tables at a cosine of {cosine}; take fewer bits")
    return n


def candidates(roots: DataFrame, least: float, recall: float = 0.99, bits: int | None = None, n_probes: int = 16, seed: int = 42, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b, of vectors (root, vector) that meet, each once. bits: by default
    such that a bucket has some 30 vectors on average."""
    n = roots.count()
    some = roots.head()
    if some is None:
        return roots.select(F.col("root").alias("a"), F.col("root").alias("b"))
    dim = len(some.vector)
    bits = bits or max(4, min(60, round(math.log2(max(n, 2))) - 5))
    tables = tables_for(least, bits, n_probes, recall)

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
        for b in batches:
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for t in range(tables):
                own, near = probes(v @ planes[t].T, n_probes)
                times = near.shape[1]
                root = b.column("root").take(pa.array(np.repeat(np.arange(len(v)), times)))
                cols = [root, pa.array(np.full(len(root), t, np.int32)), pa.array(near.ravel()), pa.array(np.tile(np.arange(times) == 0, len(v)))]
                yield pa.RecordBatch.from_arrays(cols, ["root", "table", "bucket", "own"])

    same = roots.where(F.size("vector") == dim)
    filed = kept(same.mapInArrow(run, same.select("root").schema.add("table", T.IntegerType()).add("bucket", T.LongType()).add("own", T.BooleanType())), "filed")
    keys = ["table", "bucket"]
    dealt, sent = parted(filed.where("own").select(*keys, F.col("root").alias("x")), filed.select(*keys, F.col("root").alias("y")), keys, "x", split)
    return dealt.join(sent, [*keys, "part"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(roots: DataFrame, least: float, **how) -> DataFrame:
    """(a, b, cosine): pairs of different vectors (root, vector; see vector_classes)
    with a cosine of ``least`` or more, found by hashing; how: see candidates.
    Vectors of another length than the first one's take no part. Hashing leaves out
    what a recall under 1 allows for; a recall of 1 is the comparison of all."""
    if how.get("recall") == 1:
        return exact_pairs(roots, least)
    met = candidates(roots, least, **how)
    one = met.join(roots.select(F.col("root").alias("a"), F.col("vector").alias("u")), "a")
    both = one.join(roots.select(F.col("root").alias("b"), F.col("vector").alias("v")), "b")
    cosine = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least)


def exact_pairs(roots: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """The same pairs by comparing all, a cell of two blocks of rows at a time. A task
    holds two blocks and the products of PRODUCTS pairs at most; a row is sent once
    for each block. Products grow with the square of the rows, and so, divided by
    the block, does what is sent."""
    n = roots.count()
    # a small table is divided too, so that several tasks share it
    blocks = max(1, -(-n // block), min(8, n // 1_000))
    own = roots.withColumn("own", F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = own.select("root", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(cell: pa.Table) -> pa.Table:
        root, mine = cell.column("root").combine_chunks(), cell.column("own").to_numpy()
        vector = cell.column("vector").combine_chunks()
        flat, start = vector.values.to_numpy(), vector.offsets.to_numpy()
        lengths, i, j = np.diff(start), cell["i"][0].as_py(), cell["j"][0].as_py()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for d in np.unique(lengths):
            first, second = (np.flatnonzero((lengths == d) & (mine == k)) for k in (i, j))
            v = flat[start[second][:, None] + np.arange(d)].T
            step = max(1, PRODUCTS // max(1, len(second)))
            for at in range(0, len(first), step):
                some = first[at:at + step]
                s = flat[start[some][:, None] + np.arange(d)] @ v
                x, y = np.nonzero(s >= least)
                s = s[x, y]
                if i == j:  # of a block with itself each pair once
                    once = some[x] < second[y]
                    x, y, s = x[once], y[once], s[once]
                found.append((some[x], second[y], s))
        x, y, s = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": root.take(pa.array(x)), "b": root.take(pa.array(y)), "cosine": pa.array(s, pa.float64())})

    schema = roots.select(F.col("root").alias("a"), F.col("root").alias("b")).schema.add("cosine", T.DoubleType())
    return cells.groupBy("i", "j").applyInArrow(run, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
