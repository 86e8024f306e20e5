"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly,
and each group of equal texts goes where the dot product of its sizes with the
shards' residual capacity is highest.

1. Rows are reduced to sizes and a 128-bit hash of the text; equal texts are
   summed up (combined before the shuffle) to one group each.
2. Groups of more than 1/LARGE of a shard's bytes, tokens or rows (at most
   3 * LARGE * shards of them) are placed by the driver, largest first; a group
   that no shard can hold is cut into equal parts.
3. All other groups are packed by their partitions into FINE bundles or more for
   each shard; the driver then places the bundles (shards * BUNDLES of them, or
   partitions * shards * FINE if that is more).
4. Rows meet their group's place by a join whose sides both have plain exchanges,
   so that a text that a third of all rows hold is split. The rows of a cut group
   are dealt out in turn by each task, whatever their ids. The joined rows are
   written with a running number for each partition and shard; a sum over these
   counts gives gapless slots without a sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import width, written

LARGE = 64
#: Partitions that pack groups, at most.
PACKERS = 8192
#: Bundles of a partition for each shard, at least, and of all partitions together for each shard where these are few.
FINE, BUNDLES = 4, 1024
#: Bytes, tokens and rows in the dot product. The law is near equal bytes, so bytes weigh most.
WEIGHTS = np.array([8.0, 1.0, 1.0])


def place(sizes: np.ndarray, load: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Each item's shard, largest item first. sizes: items x measures; load: shards
    x measures, updated; capacity: of one shard, by measure."""
    unit = np.where(capacity > 0, capacity, 1.0)
    x = sizes / unit
    full = load / unit
    out = np.empty(len(x), np.int64)
    for i in np.argsort(-x.max(axis=1), kind="stable").tolist():
        k = int(((1.0 - full) @ (WEIGHTS * x[i])).argmax())
        full[k] += x[i]
        out[i] = k
    load[:] = full * unit
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text plus 1; tokens: words between ASCII white space.
    law is "bytes": shards' sizes are near equal, and no shard but those of texts
    too frequent for one shard breaks up equal texts. slot runs from 0 without gaps
    in each shard. grown_shard is null, for this law does not fix where rows go
    when shards are added. Null texts are a group of their own, apart from empty
    ones, with no bytes and crc 0. Null and repeated ids are placed like any other
    row. Very long texts are placed like any other; one larger than a shard's share
    makes its shard the largest. An empty table gives an empty table. Other columns
    are not read.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    text = F.col("t")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")), F.lit(0)).cast("long").alias("tokens"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("h1"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("second"), text)).alias("h2"),
    )
    rows = written(rows, "rows")
    groups = written(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "n")]).first()
    capacity = np.array([float(x) / shards for x in total])
    load = np.zeros((shards, 3))

    is_large = (F.col("bytes") > capacity[0] / LARGE) | (F.col("tokens") > capacity[1] / LARGE) | (F.col("n") > capacity[2] / LARGE)
    large = groups.where(is_large).collect()  # 3 * LARGE * shards at most
    parts, sizes = [], []
    for g in large:
        v = np.array([g["bytes"], g["tokens"], g["n"]], float)
        k = min(int(g["n"]), max(1, int(np.ceil((v[[0, 2]] / capacity[[0, 2]]).max()))))
        for p in range(k):
            parts.append((g["h1"], g["h2"], p))
            sizes.append(v / k)
    where = place(np.array(sizes).reshape(-1, 3), load, capacity)
    fixed = spark.createDataFrame([(*p, int(s)) for p, s in zip(parts, where)], "h1 long, h2 long, part int, shard int")

    packers = min(PACKERS, width(spark))
    bins = shards * max(FINE, -(-BUNDLES // packers))

    def bundle(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        v = np.concatenate([np.stack([b.column(c).to_numpy().astype(float) for c in ("bytes", "tokens", "n")], axis=1) for b in got])
        to = place(v, np.zeros((bins, 3)), v.sum(axis=0) / bins)
        i = 0
        for b in got:
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), pa.array(np.full(b.num_rows, pid * bins) + to[i:i + b.num_rows]), b.column("bytes"), b.column("tokens"), b.column("n")], ["h1", "h2", "bundle", "bytes", "tokens", "n"])
            i += b.num_rows

    small = groups.where(~is_large).repartition(packers, "h1").mapInArrow(bundle, "h1 long, h2 long, bundle long, bytes long, tokens long, n long")
    small = written(small, "bundles")
    sums = small.groupBy("bundle").agg(F.sum("bytes"), F.sum("tokens"), F.sum("n")).collect()
    where = place(np.array([[float(x) for x in r[1:]] for r in sums]).reshape(-1, 3), load, capacity)
    of_bundle = spark.createDataFrame([(r["bundle"], int(s)) for r, s in zip(sums, where)], "bundle long, shard int")
    places = written(
        small.join(F.broadcast(of_bundle), "bundle").select("h1", "h2", F.lit(0).alias("part"), "shard")
        .unionAll(fixed).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("part", "shard")))["shard"].alias("to")), "places")

    def number(batches):
        from pyspark import TaskContext

        pid, seen, turn = TaskContext.get().partitionId(), np.zeros(shards, np.int64), {}
        for b in batches:
            to = b.column("to")
            ends = to.offsets.to_numpy()
            s = to.values.to_numpy()[ends[:-1]].copy()  # one place, but for cut groups
            cut = np.flatnonzero(np.diff(ends) > 1)
            hashes = np.stack([b.column(c).to_numpy()[cut] for c in ("h1", "h2")], axis=1)
            for group in np.unique(hashes, axis=0):
                own = cut[(hashes == group).all(axis=1)]
                places = to.values.to_numpy()[ends[own[0]]:ends[own[0] + 1]]
                at = turn.get(tuple(group), pid)  # tasks begin at different places
                s[own] = places[(at + np.arange(len(own))) % len(places)]
                turn[tuple(group)] = at + len(own)
            at = np.empty(len(s), np.int64)
            for k in np.unique(s).tolist():
                own = s == k
                at[own] = seen[k] + np.arange(own.sum())
                seen[k] += own.sum()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(s), pa.array(np.full(len(s), pid, np.int64)), pa.array(at)], ["doc_id", "size", "text_crc32", "shard", "pid", "at"])

    met = rows.join(places, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "h1", "h2", "to")
    dealt = written(met.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, pid long, at long"), "dealt")
    base, offsets = [0] * shards, []
    for r in dealt.groupBy("shard", "pid").count().orderBy("shard", "pid").toLocalIterator():
        offsets.append((r["shard"], r["pid"], base[r["shard"]]))
        base[r["shard"]] += r["count"]
    # one row for each shard and task
    offsets = spark.createDataFrame(offsets, "shard int, pid long, base long")
    return dealt.join(F.broadcast(offsets), ["shard", "pid"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
