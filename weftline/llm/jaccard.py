"""Near-copies by the Jaccard similarity of word shingles: SimHash fingerprints and
MinHash bands find candidates, the shingle sets themselves decide.

1. Texts with the same words (A-Z lower-cased, ASCII white space) are one node.
2. Op10's SimHash: nodes whose fingerprints are linked, over any number of links,
   form a bucket. Few of the pairs at a similarity of 0.8 are within its four bits, so
   there are BANDS keys of ROWS minima each as well; at a similarity of 0.8 a pair has a key in
   common but for 1.3 cases in ten million, and fewer above.
3. Nodes with a key in common form a bucket. Buckets of the same nodes, as near
   copies have in many bands, are one.
4. Sets are made where the texts lie, of nodes in a bucket (and of a few others that
   share a bit with one); no text leaves its task. Each bucket's nodes meet in one task with their whole sets, a bucket at a time.
   It is searched from one node to the next: what is similar to a node is linked to
   it and compared with the rest only, so a bucket gives a forest of links, fewer
   than it has nodes, that connects whatever is similar in it. No pair is a row.
5. A bucket of more than ELEMENTS shingles is cut into blocks, and each pair of
   blocks is searched as a cell of its own, so no cell outgrows a task.
6. Components over the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, grouped, prepare, text_bytes, width, written

K, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
#: Cells of so many nodes or fewer are compared set by set, larger ones by counts over a common vocabulary.
SMALL = 32
#: Shingles of a cell, or of a block of one: 8 bytes each.
ELEMENTS = 4_000_000
#: Bits, 64 to a row, that tell tasks which ids may be in a bucket; too few let more through, and change no result.
NEEDED = 1 << 24
MULTIPLIERS = np.random.default_rng(42).integers(1, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int = K) -> tuple[int, np.ndarray]:
    """(key of the text's words, its sorted distinct shingles' XXH64). Fewer than k words: the whole sequence; no word: no shingle."""
    words = text.lower().split()
    if not words:
        return 0, np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    last = ends[k - 1:].tolist() if len(words) >= k else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return digest(joined, 1), np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, last)), np.uint64, len(last)))


def bands(s: np.ndarray) -> np.ndarray:
    """A set's band keys, as signed longs."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (MULTIPLIERS[:, None] * s[None, i:i + 512]).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketches(batches):
    for b in batches:
        found = [shingles(x) for x in b.column(1).to_pylist()]
        key = np.array([k for k, _ in found], np.uint64).view(np.int64)
        flat = np.concatenate([bands(s) for _, s in found]) if found else np.empty(0, np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        fp = np.array([simhash.fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([len(s) for _, s in found], pa.int64()), listed, pa.array(fp)], ["id", "key", "size", "bands", "fp"])


def spread(ids: np.ndarray) -> np.ndarray:
    """The bit of each id, the same for equal ids."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(NEEDED)


def needed(ids: DataFrame) -> np.ndarray:
    """NEEDED bits, as bytes: those of the longs in the only column. Each task sends a
    row for 64 bits at most, and so does the driver's result."""

    def bits(batches):
        for b in batches:
            at = spread(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((at // 64).astype(np.int32)), pa.array((np.uint64(1) << at % 64).view(np.int64))], ["at", "bit"])

    got = ids.mapInArrow(bits, "at int, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(NEEDED // 64, np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out


def sets(marks: np.ndarray):
    """For mapInArrow: (id, key, set) of the rows whose id may be needed."""

    def run(batches):
        for b in batches:
            at = spread(b.column(0).to_numpy())
            b = b.filter(pa.array((marks[at // 64].view(np.uint64) >> at % 64 & np.uint64(1)).astype(bool)))
            found = [shingles(x) for x in b.column(1).to_pylist()]
            key = np.array([k for k, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "key", "set"])

    return run


def forest(found: list[np.ndarray], least: float, small: int) -> list[tuple[int, int]]:
    """(i, j): links that connect whatever of ``found``, sorted sets, is similar."""
    out, queue, rest = [], [], np.arange(len(found))
    size = np.array([len(s) for s in found])
    if len(found) > small:
        flat = np.unique(np.concatenate(found), return_inverse=True)[1]
        begin = np.cumsum(size) - size
        held = flat  # the shingles of rest, one node after another
    while len(rest):
        if queue:
            i = queue.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
            if len(found) > small:
                held = held[size[i]:]
        if not len(rest):
            break
        if len(found) > small:
            mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
            mark[flat[begin[i]:begin[i] + size[i]]] = True
            ends = np.concatenate([[0], np.cumsum(mark[held])])
            place = np.cumsum(size[rest])
            both = ends[place] - ends[place - size[rest]]
            either = size[i] + size[rest] - both
            near = np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least
        else:
            near = np.array([similarity(found[i], found[j]) >= least for j in rest.tolist()])
        if near.any():
            hit = rest[near].tolist()
            out += [(i, j) for j in hit]
            queue += hit
            if len(found) > small:
                held = held[np.repeat(~near, size[rest])]
            rest = rest[~near]
    return out


def links(distinct: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between nodes that connect all that are similar. distinct: key,
    size, bands, fp and first, an id whose text has that key."""
    spark, small = distinct.sparkSession, SMALL
    close = written(components(simhash.links(distinct.select("fp").distinct())).select(F.col("node").alias("fp"), "root"), "close")
    alike = distinct.select("key", "size", "fp").join(close, "fp", "left").select("key", "size", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"))
    members = distinct.select("key", "size", F.explode("bands").alias("band")).unionAll(alike)
    buckets = members.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "key")).alias("h2")).where("n > 1")
    buckets = buckets.groupBy("n", "h1", "h2").agg(F.min("band").alias("band"), F.max("total").alias("total"))
    buckets = written(buckets.select("band", F.greatest(F.lit(1), F.ceil(F.col("total") / ELEMENTS)).cast("long").alias("blocks")), "buckets")
    members = written(members.join(buckets, "band").select("band", "key", "blocks"), "members")
    need = written(members.select("key").distinct().join(distinct.select("key", "first"), "key").select(F.col("key").alias("need"), "first"), "need")
    made = rows.mapInArrow(sets(needed(need.select("first"))), "id long, key long, set binary")
    made = made.join(need, (made["id"] == need["first"]) & (made["key"] == need["need"])).select("key", "set")
    held = written(made.groupBy("key").agg(F.first("set").alias("set")), "sets")
    own = F.pmod(F.xxhash64("key"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
    cells = members.join(held, "key").select("band", F.explode(pairs).alias("pair"), "key", "set")

    def search(batches):
        cell, keys, found = None, [], []

        def links_of():
            pairs = forest(found, least, small)
            return pa.RecordBatch.from_arrays([pa.array([keys[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for band, pair, key, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, pair) != cell:
                    if len(keys) > 1:
                        yield links_of()
                    cell, keys, found = (band, pair), [], []
                keys.append(key), found.append(np.frombuffer(s, np.uint64))
        if len(keys) > 1:
            yield links_of()

    dealt = cells.repartition(4 * width(spark), "band", "pair").sortWithinPartitions("band", "pair")
    out = written(dealt.mapInArrow(grouped(search), "a long, b long"), "links")
    discard(close, buckets, members, need, held)
    return out


def one_of_each(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component of texts whose sets of
    5-word shingles have a Jaccard similarity of ``least`` or more; the columns of
    docs, which may have any name.

    Texts of fewer than five words are one shingle. Null, empty and blank texts are
    equal. Very long texts are compared whole. Rows without an id stay. Of rows that repeat an id all stay or none. An
    empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    found = written(rows.mapInArrow(sketches, "id long, key long, size long, bands array<long>, fp long"), "sketch")
    distinct = written(found.groupBy("key").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "distinct")
    roots = components(links(distinct, rows, least))
    known = distinct.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = written(known, "known")
    stays = written(known.groupBy("root").agg(F.min("first").alias("stays")), "stays")
    known = written(known.join(stays, "root").select("key", "stays"), "keys")
    gone = found.select("id", "key").join(known, "key").where("id <> stays").select(F.col("id").alias("__gone")).distinct()
    gone = written(gone, "gone")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
