"""Best-fit packing of documents' token pieces into sequences of fixed capacity.

Hierarchical residual packing: each partition packs its pieces best-fit
decreasing and emits nearly full bins; underfull bins become the items of the
next round over fewer partitions, until one partition is left. A bin that no
remaining item fits is emitted as well, so what a round passes on is little. A
task packs ITEMS items at a time, and a round has a partition for each ITEMS of
them, so no task grows with the input; where rounds of more than one partition
stop saving bins, the packing is done. Plans hold ids, lengths and places only,
never texts.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .tokens import encoder

#: A bin with no more than this share of its capacity free is nearly full.
NEARLY = 1 / 256
#: Partitions of one round that meet in one of the next.
FAN_IN = 8
#: Items that a task holds and packs together.
ITEMS = 500_000
#: Rounds over several partitions go on while each saves this share of its bins.
GAIN = 1 / 200


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, byte_level: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end
    id, cut into pieces of ``capacity`` ids, the last one shorter. A null or empty
    text is one piece, the end id alone. Rows that repeat an id stay, one set of
    pieces each; rows with a null id stay. ids_crc32 is over little-endian
    unsigned 32-bit ids."""
    prepare(docs.sparkSession)

    def run(batches):
        code = encoder(tokenizer, byte_level)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(code.encode([text or ""])[0], end_id).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k:k + capacity]
                    rows.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and the bins' fill.
    Bins are found by residual, in a bit set of the residuals that occur."""
    where, offset, fill = np.empty(len(length), np.int64), np.empty(len(length), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if r > n:
            if not open_bins[r - n]:
                free |= 1 << (r - n)
            open_bins[r - n].append(b)
    return where, offset, np.array(fill, np.int64)


def packed_once(items: DataFrame, capacity: int, round_no: int) -> DataFrame:
    """items (item, length) -> (item, bin, at, fill), ITEMS of each partition at a time."""
    most = ITEMS

    def run(batches):
        from pyspark import TaskContext

        base, got, held = (round_no << 56) + (TaskContext.get().partitionId() << 32), [], 0
        for b in itertools.chain(batches_of(batches, most), [None]):
            if got and (b is None or held + b.num_rows > most):
                where, at, fill = best_fit(np.concatenate([x.column(1).to_numpy() for x in got]), capacity)
                i = 0
                for x in got:
                    w = where[i:i + x.num_rows]
                    yield pa.RecordBatch.from_arrays([x.column(0), pa.array(base + w), pa.array(at[i:i + x.num_rows]), pa.array(fill[w])], ["item", "bin", "at", "fill"])
                    i += x.num_rows
                base, got, held = base + len(fill), [], 0
            if b is not None:
                got.append(b)
                held += b.num_rows

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, bin long, at long, fill long")


def batches_of(batches, most: int):
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; lengths from 1 to
    capacity) plus sequence_id and offset. Equal rows are packed one by one, null
    ids like any other. An empty table gives an empty table."""
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    first = written(packed_once(pieces.select(item.alias("item"), "length"), capacity, 0).select("item.*", "bin", "at", "fill"), "bins")
    full = capacity - int(capacity * NEARLY)
    left = first.where(F.col("fill") < full).select("bin", "fill").distinct()
    moves = None  # first bin -> bin so far, its offset there
    round_no, tasks = 0, max(1, first.rdd.getNumPartitions())
    before = None  # items of the round before, and its partitions
    while True:
        left = written(left, "left")
        least = left.agg(F.min("fill")).first()[0]
        if least is None:
            break
        left = left.where(F.lit(capacity) - F.col("fill") >= least)
        n = left.count()
        round_no, tasks = round_no + 1, max(-(-n // ITEMS), tasks // FAN_IN, 1)
        if before and tasks >= before[1] and n > before[0] * (1 - GAIN):
            break
        before = n, tasks
        step = written(packed_once(left.select(F.col("bin").alias("item"), F.col("fill").alias("length")).coalesce(tasks), capacity, round_no), "step")
        if moves is None:
            moves = step.select(F.col("item").alias("bin0"), "bin", "at")
        else:
            now = step.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("at").alias("plus"))
            moves = moves.join(now, "bin", "left").select("bin0", F.coalesce("next", "bin").alias("bin"), (F.col("at") + F.coalesce("plus", F.lit(0))).alias("at"))
        moves = written(moves, "moves")
        if tasks == 1:
            break
        left = step.where(F.col("fill") < full).select("bin", "fill").distinct()
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return first.select(*own, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    met = first.select(*own, F.col("bin").alias("bin0"), F.col("at").alias("at0")).join(moves, "bin0", "left")
    return met.select(*own, F.coalesce("bin", "bin0").alias("sequence_id"), (F.col("at0") + F.coalesce("at", F.lit(0))).alias("offset"))


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, byte_level: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to packed pieces, one row a piece; see token_pieces and pack for
    what nulls, repeated rows, very long texts and empty tables give. Columns of
    docs other than the two named are not read."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, byte_level, id_col, text_col), "pieces"), capacity)
