"""SimHash near-dedup by a segment-popcount embedding.

1. A 64-bit fingerprint of each text, from word shingles.
2. A fingerprint is embedded as its bit counts in 32 segments of 2 bits. One
   differing bit changes one count by at most one, so the Manhattan distance of
   the counts is a lower bound of the Hamming distance.
3. Grid range-join: fingerprints within Hamming distance 4 are within Manhattan
   distance 2 on the first or on the last sixteen segments. Two lattice points
   within distance 2 have a lattice point within 1 of both, so each fingerprint
   is sent to its own cell and the next cells (24 on average) of either half, and
   every linked pair meets in one cell at least. Of unrelated fingerprints one
   pair in 13,000 meets.
4. In a cell pairs are verified exactly by Hamming distance. A cell returns a
   forest of links (fewer than it has fingerprints), never all pairs. Cells come
   sorted and one at a time, so a task holds one cell and one batch. A cell of
   more than CELL fingerprints is cut into blocks, and each pair of blocks is a
   cell of its own, so no cell outgrows a task.
5. Components over distinct fingerprints, in rounds of joins.

Equal texts are one distinct fingerprint before anything is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, prepare, text_bytes, width, written

SEGMENTS, SEGMENT_BITS, HALF = 32, 2, 16
#: Bits of a count in a cell's key.
COUNT_BITS = 2
#: The grid's radius and the split in two halves are for this many differing bits or fewer.
MAX_BITS = 4
#: Fingerprints of a cell, or of a block of one.
CELL = 100_000
KEY_BITS = HALF * COUNT_BITS + 1
#: Cells of more fingerprints than this are searched from one fingerprint to the next instead of pair by pair.
DENSE = 256


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """A-Z lower-cased, words between ASCII white space, k-word shingles with
    repeats (fewer words: the whole sequence; none: zero); a bit is set if it is
    set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    last = ends[k - 1:].tolist() if len(words) >= k else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i:i + 16384].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp the fingerprint's bits as a signed long. Null text: zero."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(x, k, seed) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def own_cells(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either half: (each fingerprint's counts, the key of its own cell). A key
    holds the half and its counts."""
    shift = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
    counts = np.bitwise_count((fp.view(np.uint64)[:, None] >> shift) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)
    halves = [counts[:, half * HALF:(half + 1) * HALF] for half in range(2)]
    return [(c, (half << (HALF * COUNT_BITS)) + (c << (COUNT_BITS * np.arange(HALF))).sum(axis=1)) for half, c in enumerate(halves)]


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint's own cells and the next ones: (keys, index of the fingerprint)."""
    keys, of = [], []
    at = np.arange(len(fp))
    for c, own in own_cells(fp):
        keys.append(own), of.append(at)
        for s in range(HALF):
            for step, ok in ((1, c[:, s] < SEGMENT_BITS), (-1, c[:, s] > 0)):
                keys.append(own[ok] + (step << (COUNT_BITS * s))), of.append(at[ok])
    return np.concatenate(keys), np.concatenate(of)


def linked(fp: np.ndarray, bits: int) -> tuple[list, list]:
    """A spanning forest of the pairs within ``bits`` among distinct fingerprints."""
    a, b, found, rest = [], [], [], fp
    while len(rest):
        x = found.pop() if found else rest[0]
        near = np.bitwise_count(rest ^ x) <= bits
        hit = rest[near]
        hit = hit[hit != x]
        rest = rest[~near]
        if len(hit):
            a.append(np.full(len(hit), x)), b.append(hit)
            found.extend(hit)
    return a, b


def forest(fp: np.ndarray, size: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """fp: fingerprints cell after cell, size: the cells' sizes. (a, b): a spanning
    forest of each cell. Small cells are compared side by side, all at once, to
    find those that have a link at all."""
    begin = np.cumsum(size) - size
    cell = np.repeat(np.arange(len(size)), size)
    left = np.repeat(begin + size, size) - np.arange(len(fp)) - 1  # how many follow in the cell
    left[np.repeat(size > DENSE, size)] = 0
    has = size > DENSE
    at, step = np.flatnonzero(left), 1
    while len(at):
        has[cell[at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]]] = True
        step += 1
        at = at[left[at] >= step]
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s, n in zip(begin[has].tolist(), size[has].tolist()):
        x, y = linked(fp[s:s + n], bits)
        a += x
        b += y
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that connect all
    that are within ``bits`` (4 or fewer) of one another. Pairs may repeat."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the grid's cells are for 0 to {MAX_BITS} bits")
    spark = distinct.sparkSession

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 20_000):
                key, of = cells(fp[i:i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i:i + 20_000][of])], ["cell", "fp"])

    def search(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in with_end(batches):
            if batch is not None:
                key, fp = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
                cut = int(np.searchsorted(key, key[-1]))  # the last cell may go on
            else:
                key, fp = held
                cut = len(key)
            held = key[cut:], fp[cut:]
            if cut:
                size = np.diff(np.flatnonzero(np.concatenate([[True], key[1:cut] != key[:cut - 1], [True]])))
                x, y = forest(fp[:cut].view(np.uint64), size, bits)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def sizes(keys_of) -> DataFrame:
        def count(batches):
            for batch in batches:
                fp = batch.column(0).to_numpy()
                for i in range(0, len(fp), 20_000):
                    key, n = np.unique(keys_of(fp[i:i + 20_000]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["cell", "n"])

        return fps.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))

    fps = distinct.select("fp")
    # A cell holds the fingerprints of so many own cells at most; without a full one among these no cell is too large.
    full = sizes(lambda fp: np.concatenate([own for _, own in own_cells(fp)])).where(F.col("n") > CELL // (2 * HALF + 1))
    dealt = fps.mapInArrow(spread, "cell long, fp long")
    if full.isEmpty():
        dealt = dealt.withColumn("blocks", F.lit(None).cast("long"))
    else:
        large = sizes(lambda fp: cells(fp)[0]).where(F.col("n") > CELL)
        large = written(large.select("cell", F.ceil(F.col("n") / CELL).cast("long").alias("blocks")), "large")
        dealt = dealt.join(large, "cell", "left")
    own = F.pmod(F.xxhash64("fp"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
    dealt = dealt.select(F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("long")))).alias("pair"), "cell", "fp")
    dealt = dealt.select((F.shiftleft("pair", KEY_BITS) + F.col("cell")).alias("cell"), "fp")
    return dealt.repartition(4 * width(spark), "cell").sortWithinPartitions("cell").mapInArrow(search, "a long, b long")


def with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = MAX_BITS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document with an id: its fingerprint
    (bits as a signed long) and the smallest id reachable over links of ``bits``
    or fewer differing bits.

    Null or empty texts and texts of white space have fingerprint zero and link
    like any other. Rows without an id are left out; rows that repeat an id stay,
    one result row each. An empty table gives an empty table. Other columns are
    not read, so their names may clash with these.
    """
    each = written(fingerprints(docs.where(F.col(id_col).isNotNull()), k, seed, id_col, text_col), "fp")
    distinct = written(each.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(distinct, bits))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = written(known.join(least, "root").select("fp", "component_id"), "known")
    return each.join(known, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The document with the smallest id of each component; the columns of docs,
    which may have any name. Null and empty texts are equal. Rows without an id stay.
    Of rows that repeat an id all stay or none. An empty table gives an empty table."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
