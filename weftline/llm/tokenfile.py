"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents:

    magic "WPFR", block size u32, ids u64, blocks u64, documents u64
    document ids i64 x documents, their first id in the file u64 x (documents + 1)
    where each block starts in the block section u64 x (blocks + 1)
    the blocks

    a block: minimum u32, width u8, exceptions u8,
             id - minimum at that width (exceptions: 0), 64 values to ``width`` 64-bit words,
             places of the exceptions u8 each, their id - minimum u32 each

The width is the least that holds PERCENTILE of the block's values. The last
block is filled up with its minimum. All numbers are little-endian.

Files are written by executors into the shared folder under names of their own
for each attempt; the manifest lists those of the attempts that succeeded, so a
lost executor leaves nothing that is read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, passing, prepare, width, written
from .tokens import encoder

MAGIC, BLOCK, PERCENTILE = b"WPFR", 256, 0.9
HEAD = struct.Struct("<4sIQQQ")
#: A file ends with the document that takes it over so many ids.
FILE_IDS = 1 << 21
#: So many ids are packed at a time.
ENCODE_IDS = 1 << 17


def shift_in(v: np.ndarray, w: int) -> np.ndarray:
    """(64, n) values of w bits -> (w, n) 64-bit words."""
    out = np.zeros((w, v.shape[1]), np.uint64)
    for i in range(64):
        j, s = divmod(i * w, 64)
        out[j] |= v[i] << np.uint64(s)
        if s + w > 64:
            out[j + 1] |= v[i] >> np.uint64(64 - s)
    return out


def shift_out(words: np.ndarray, w: int) -> np.ndarray:
    out = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(64):
        j, s = divmod(i * w, 64)
        v = words[j] >> np.uint64(s)
        if s + w > 64:
            v |= words[j + 1] << np.uint64(64 - s)
        out[i] = v & mask
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (unsigned, up to 32 bits) -> (block starts u64, bytes of all blocks)."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[:len(ids)] = ids
    if n:
        v[len(ids):] = v[(n - 1) * BLOCK:len(ids)].min()
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1)
    v -= low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    w = np.frexp(np.partition(v, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)  # bits of the percentile
    odd = v > ((np.uint64(1) << w.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    exc = odd.sum(axis=1)
    start = np.zeros(n + 1, np.uint64)
    np.cumsum(6 + w.astype(np.int64) * (BLOCK // 8) + exc * 5, out=start[1:], dtype=np.uint64)
    buf = np.zeros(int(start[-1]), np.uint8)
    begin = start[:-1].astype(np.int64)
    buf[begin[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    buf[begin + 4] = w
    buf[begin + 5] = exc
    plain = np.where(odd, np.uint32(0), v)
    view = memoryview(buf)
    for x in np.unique(w[w > 0]).tolist():
        of = np.flatnonzero(w == x)
        words = shift_in(np.ascontiguousarray(plain[of].reshape(-1, 64).T).astype(np.uint64), x)
        data, size = memoryview(np.ascontiguousarray(words.T).astype("<u8").tobytes()), x * BLOCK // 8
        for k, b in enumerate((begin[of] + 6).tolist()):
            view[b:b + size] = data[k * size:(k + 1) * size]
    row, place = np.nonzero(odd)
    k = np.arange(len(row)) - np.repeat(np.cumsum(exc) - exc, exc)
    head = begin[row] + 6 + w[row].astype(np.int64) * (BLOCK // 8)
    buf[head + k] = place
    buf[(head + exc[row] + 4 * k)[:, None] + np.arange(4)] = v[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return start, buf


def decode_blocks(start: np.ndarray, buf: np.ndarray, first: int = 0) -> np.ndarray:
    """The ids of the blocks whose starts are given (one more than blocks); buf
    begins at byte ``first`` of the block section."""
    begin = start[:-1].astype(np.int64) - first
    n = len(begin)
    low = buf[begin[:, None] + np.arange(4)].reshape(-1).view("<u4")
    w, exc = buf[begin + 4].astype(np.int64), buf[begin + 5].astype(np.int64)
    out, view = np.zeros((n, BLOCK), np.uint32), memoryview(np.ascontiguousarray(buf))
    for x in np.unique(w[w > 0]).tolist():
        of = np.flatnonzero(w == x)
        size = x * BLOCK // 8
        words = np.frombuffer(b"".join([view[b:b + size] for b in (begin[of] + 6).tolist()]), "<u8").reshape(-1, x)
        out[of] = np.ascontiguousarray(shift_out(np.ascontiguousarray(words.T), x).astype(np.uint32).T).reshape(len(of), BLOCK)
    row = np.repeat(np.arange(n), exc)
    k = np.arange(len(row)) - np.repeat(np.cumsum(exc) - exc, exc)
    head = begin[row] + 6 + w[row] * (BLOCK // 8)
    out[row, buf[head + k]] = buf[(head + exc[row] + 4 * k)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    return (out + low[:, None]).reshape(-1)


class Blocks:
    """The blocks of ids that come a few at a time. At most ENCODE_IDS of them are
    held in the wider arrays that packing needs; a long text is fed in pieces."""

    def __init__(self, dtype):
        self.held, self.n_held, self.n_ids, self.size = [], 0, 0, 0
        self.dtype, self.starts, self.packed = dtype, [np.zeros(1, np.uint64)], []

    def add(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), ENCODE_IDS):
            piece = ids[at:at + ENCODE_IDS]
            self.held.append(piece)
            self.n_held += len(piece)
            self.n_ids += len(piece)
            if self.n_held >= ENCODE_IDS:
                self.pack(self.n_held // BLOCK * BLOCK)

    def pack(self, n: int) -> None:
        """Pack the first n of the ids that are held, whole blocks but at the end."""
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        start, buf = encode_blocks(flat[:n])
        self.starts.append(start[1:] + np.uint64(self.size))
        self.size += len(buf)
        self.packed.append(buf.tobytes())
        self.held, self.n_held = [flat[n:].copy()], len(flat) - n

    def close(self) -> tuple[np.ndarray, list[bytes]]:
        self.pack(self.n_held)
        return np.concatenate(self.starts), self.packed


def file_parts(doc_ids: list[int], lengths: list[int], blocks: Blocks) -> list[bytes]:
    start, packed = blocks.close()
    first = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=first[1:])
    return [HEAD.pack(MAGIC, BLOCK, blocks.n_ids, len(start) - 1, len(doc_ids)), np.array(doc_ids, "<i8").tobytes(), first.tobytes(), start.astype("<u8").tobytes(), *packed]


def to_bytes(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    blocks = Blocks(np.uint32)
    for x in ids:
        blocks.add(np.asarray(x))
    return b"".join(file_parts(doc_ids, list(map(len, ids)), blocks))


class Reader:
    """Random access to a file's documents by the block index."""

    def __init__(self, data: bytes):
        magic, block, self.n_ids, n_blocks, self.n_docs = HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a file of this format")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.first = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * self.n_docs + 8
        self.start = np.frombuffer(data, "<u8", n_blocks + 1, at)
        self.data = np.frombuffer(data, np.uint8, offset=at + 8 * n_blocks + 8)

    def ids(self, i: int, j: int) -> np.ndarray:
        """The ids of documents i to j - 1, one after another."""
        a, b = int(self.first[i]), int(self.first[j])
        if a == b:
            return np.empty(0, np.uint32)
        lo, hi = a // BLOCK, -(-b // BLOCK)
        s = self.start[lo:hi + 1]
        got = decode_blocks(s, self.data[int(s[0]):int(s[-1])], int(s[0]))
        return got[a - lo * BLOCK:b - lo * BLOCK]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, byte_level: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the ids in ascending order of ids. The
    manifest: (part, file_no, path, n_docs, n_ids), in file order by (part,
    file_no). Null texts: no ids but the end id. A very long text is encoded whole
    and packed piece by piece. Rows that repeat an id stay, next
    to one another and in no fixed order, and may be dealt over several tasks. Rows
    without an id come first, under the smallest integer. An empty table: an empty
    manifest. Other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches):
        from pyspark import TaskContext

        code, part = encoder(tokenizer, byte_level), TaskContext.get().partitionId()
        rows, doc_ids, lengths, blocks = [], [], [], Blocks(code.dtype)

        def close():
            nonlocal doc_ids, lengths, blocks
            path = f"{folder}/{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.pfor"
            fs, at = file_system(path)
            with fs.open_output_stream(at) as out:
                for x in file_parts(doc_ids, lengths, blocks):
                    out.write(x)
            rows.append((part, len(rows), path, len(doc_ids), blocks.n_ids))
            doc_ids, lengths, blocks = [], [], Blocks(code.dtype)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                got = code.encode([text.as_py() or ""])[0]
                got = got if end_id is None else np.append(got, np.array([end_id], got.dtype))
                doc_ids.append(doc), lengths.append(len(got)), blocks.add(got)
                if blocks.n_ids >= FILE_IDS:
                    close()
        if doc_ids:
            close()
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file_no", "path", "n_docs", "n_ids"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The row's number splits the range of an id that many rows have.
    rows = rows.withColumn("no", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(2 * width(spark), "id", "no").sortWithinPartitions("id", "no").select("id", "text")
    return written(dealt.mapInArrow(run, "part int, file_no int, path string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame, digest: bool = True) -> DataFrame:
    """Decode the files of a manifest: (doc_id, start, n_tokens, ids_crc32), or
    with digest=False also ids (array of longs) in place of the crc. An empty
    manifest: no rows. start counts
    the ids of all documents before: a running sum over the files of a task, plus
    the sum of the tasks before it. The driver sees one number for each task that wrote."""
    spark = manifest.sparkSession
    sums = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_ids"), F.count("*")).collect()))
    base, before = 0, []
    for part, n, _ in sums:
        before.append((part, base))
        base += n
    within = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    table = manifest.join(F.broadcast(spark.createDataFrame(before, "part int, base long")), "part")  # a row for each task
    table = table.select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("first"))
    n_files = sum(n for *_, n in sums)

    def run(batches):
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = file_system(path)
                with fs.open_input_stream(at) as f:
                    r = Reader(f.read())
                i = 0
                while i < r.n_docs:  # about a quarter of a million ids at a time
                    j = max(i + 1, bisect.bisect_right(r.first, int(r.first[i]) + (1 << 18)) - 1)
                    got, cut = r.ids(i, j).astype("<u4"), r.first[i:j + 1] - r.first[i]
                    parts = [got[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    last = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if digest else pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[i:j]), pa.array(first + r.first[i:j]), pa.array(np.diff(cut)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                    i = j

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    if n_files:
        table = table.repartition(min(n_files, width(spark)))
    return table.mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = 2, byte_level: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a new folder in the shared one, which stays as long as the
    application, and read back; see write_tokens for what nulls, repeated ids and
    empty tables give. Rows come in any order; those that repeat an id have a
    ``start`` each."""
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "tokens")
    manifest = write_tokens(docs, tokenizer, folder, end_id, byte_level, id_col, text_col)
    passing(spark, folder)
    return read_tokens(manifest)
