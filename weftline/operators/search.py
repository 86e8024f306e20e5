"""Text search by an inverted index of trigrams, kept as tables.

Texts are numbered in blocks: a block's number and a short place in it. A task makes
the postings of a block at once, so that a trigram's places in it are one row, and
what is shuffled and written is two bytes a place. Postings lie by a hash of their
trigram, the texts' ids of each block by a hash of the block, the rows that carry
the texts by a hash of the text. A query reads the folders of its own trigrams only:
first how many texts each has, then the numbers of its rarest few, which are
intersected; what is left is looked up in the folders of these texts and compared
with the query itself. So an answer is what a scan finds.
Rows are added in batches, each with postings of its own for the texts that are new;
all tables change in one commit. ``merge`` makes one batch of the small ones, so
that an index of many batches has few files for a trigram; a row is written anew
about as often as the number of rows has doubled. Blocks stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.tables import TableSet

from .iterate import dropped, kept, text_batches

#: Texts of a block at most: a place is a short.
GRAM, BLOCK = 3, 4096
#: Characters of a block at most, and of a longer text's pieces.
BLOCK_CHARS = 1 << 22
#: Bytes of a file that tell nothing of how many rows it has.
FOOT = 4096
#: Bits of a place in a text's number.
PLACE_BITS = 16
#: In place of a trigram: the row with the ids of a block's texts.
TEXTS = ""
#: Trigrams of a query that are intersected: rarer ones leave little for the others to do.
USED = 4
APART = "\x1f"


def hashed(c, buckets: int):
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def trigrams(text: str) -> list[str]:
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def codes(text: str) -> np.ndarray:
    """The trigrams of a text, as often as they stand, as one number each."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] << 42) + (c[1:-1] << 21) + c[2:]


def block_postings(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """(gram, block, n, places, texts) of one block, and the row of its texts' ids."""
    own = np.array(ids, np.int64)
    block = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little") >> (PLACE_BITS + 1)
    found = []
    for t in texts:  # a very long one in pieces
        found.append(codes(t) if len(t) <= BLOCK_CHARS else np.unique(np.concatenate([np.unique(codes(t[i:i + BLOCK_CHARS + GRAM - 1])) for i in range(0, len(t), BLOCK_CHARS)])))
    code = np.concatenate(found)
    place = np.repeat(np.arange(len(texts), dtype=np.int16), [len(f) for f in found])
    order = np.argsort(code, kind="stable")  # by trigram, then by place
    code, place = code[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (place[1:] != place[:-1])
    code, place = code[new], place[new]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    k, chars = code[first], np.empty((len(first), GRAM), "<u4")
    for i in range(GRAM):
        chars[:, i] = (k >> (21 * (GRAM - 1 - i))) & ((1 << 21) - 1)
    flat = chars.tobytes().decode("utf-32-le")
    grams = [flat[i:i + GRAM] for i in range(0, len(flat), GRAM)] + [TEXTS]
    ends = np.append(first, [len(code)] * 2).astype(np.int32)
    given = np.zeros(len(grams) + 1, np.int32)
    given[-1] = len(own)
    return pa.RecordBatch.from_arrays(
        [pa.array(grams, pa.string()), pa.array(np.full(len(grams), block)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), pa.ListArray.from_arrays(pa.array(given), pa.array(own))],
        ["gram", "block", "n", "places", "texts"])


class TrigramIndex:
    """An index of rows by one or more of their columns, without regard to case."""

    def __init__(self, spark: SparkSession, folder: str, columns: list[str], buckets: int = 64):
        self.spark, self.folder, self.columns, self.buckets = spark, folder, columns, buckets
        self.tables = TableSet(spark, folder)

    def _stored(self, tables: dict, name: str) -> DataFrame | None:
        """One scan over all batches of a table, with its ``bucket``."""
        entry = tables.get(name)
        if entry is None or not entry["parts"]:
            return None
        schema = T.StructType.fromJson(entry["schema"]).add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/{p}" for p in entry["parts"].values()])

    def _with(self, tables: dict, name: str, df: DataFrame) -> dict:
        at = f"data/batch={uuid.uuid4().hex}"
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
        full = any(s.isDirectory() for s in self.tables.log.fs.listStatus(self.tables.log.path(f"{self.folder}/{at}")))
        parts = tables.get(name, {"parts": {}})["parts"] | ({at: at} if full else {})
        return {"schema": json.loads(df.drop("bucket").schema.json()), "parts": parts}

    def add(self, rows: DataFrame) -> int:
        """Index rows; the version of the index after it. Rows without any text in the
        indexed columns are found by no query. A row that comes twice is there twice."""
        own = rows.withColumn("_text_id", F.xxhash64(self._text()))
        own = own.withColumn("bucket", hashed("_text_id", self.buckets))

        def make(tables: dict) -> dict:
            second = F.xxhash64(F.lit("second"), self._text()).alias("_second")  # with the id, as good as the text itself
            texts = rows.select(F.xxhash64(self._text()).alias("_text_id"), second, self._text().alias("_text")).distinct()
            known = self._stored(tables, "rows")
            if known is not None:  # only in the folders that the batch falls into
                touched = [r[0] for r in own.select("bucket").distinct().collect()]  # a number for each bucket at most
                texts = texts.join(known.where(F.col("bucket").isin(touched)).select("_text_id", second), ["_text_id", "_second"], "left_anti")
            return {"rows": self._with(tables, "rows", own), "postings": self._with(tables, "postings", self._blocks(texts))}

        return self.tables.commit(make)

    def _text(self):
        """What is indexed of a row."""
        return F.lower(F.concat_ws(APART, *self.columns))

    def _blocks(self, texts: DataFrame) -> DataFrame:
        """Postings of different texts (_text_id, _second, _text), block by block. Texts
        are sorted, so that a task that runs again makes the same blocks."""
        most, chars = min(BLOCK, 1 << 15), BLOCK_CHARS

        def run(batches):
            ids, held, size = [], [], 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if ids and (len(ids) == most or size + len(t) > chars):
                        yield block_postings(ids, held)
                        ids, held, size = [], [], 0
                    ids.append(i), held.append(t)
                    size += len(t)
            if ids:
                yield block_postings(ids, held)

        sorted_texts = text_batches(texts).where(F.length("_text") >= GRAM).sortWithinPartitions("_text_id", "_second").select("_text_id", "_text")
        made = sorted_texts.mapInArrow(run, "gram string, block long, n int, places array<short>, texts array<long>")
        return made.withColumn("bucket", F.when(F.col("gram") == TEXTS, self._block_bucket()).otherwise(hashed("gram", self.buckets)))

    def _block_bucket(self):
        """The folder of a block's row of texts: one of its own, after those of trigrams."""
        return hashed("block", self.buckets) + self.buckets

    def _small(self, parts: dict, share: float) -> dict:
        """The small ones among a table's batches: from the smallest up, as long as
        each is at most ``share`` times all before it together; none or two at least."""
        fs, path = self.tables.log.fs, self.tables.log.path
        by_size = []
        for name, at in parts.items():
            found = fs.getContentSummary(path(f"{self.folder}/{at}"))
            by_size.append((max(1, found.getLength() - FOOT * found.getFileCount()), name))
        by_size.sort()
        chosen, total = [], 0
        for size, name in by_size:
            if len(chosen) > 1 and size > share * total:
                break
            if len(chosen) == 1 and size > share * total:
                chosen = []  # far larger than the only one before it, which stays
            chosen.append(name)
            total += size
        return {n: parts[n] for n in chosen} if len(chosen) > 1 else {}

    def merge(self, share: float = 2.0) -> int:
        """Make one batch of the small ones of each table, in one commit; the version
        after it, which is the same where there is nothing to merge. Batches that
        another writer adds meanwhile stay. Only what is merged is read."""

        def make(tables: dict) -> dict:
            made = {}
            for name, entry in tables.items():
                small = self._small(entry["parts"], share)
                if not small:
                    continue
                df = self._stored({name: entry | {"parts": small}}, name).drop("batch")
                rest = {n: at for n, at in entry["parts"].items() if n not in small}
                made[name] = self._with({name: {"parts": rest}}, name, df)
            return made

        return self.tables.commit(make)

    def postings(self, grams: list[str], tables: dict | None = None) -> DataFrame | None:
        """(gram, n, ids) of trigrams, a row for each block: the numbers of the texts
        that hold it. Only their folders are read."""
        found = self._stored(self.tables.record() if tables is None else tables, "postings")
        if found is None:
            return None
        frame = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(hashed("gram", self.buckets))
        found = found.where(F.col("bucket").isin(sorted({r[0] for r in frame.collect()})) & F.col("gram").isin(grams))
        return found.select("gram", "n", F.transform("places", lambda p: F.shiftleft("block", PLACE_BITS) + p).alias("ids"))

    def _texts_of(self, numbers: DataFrame, tables: dict) -> DataFrame:
        """(_text_id) of texts by their numbers (id), written."""
        numbers = kept(numbers.select(F.shiftright("id", PLACE_BITS).alias("block"), F.col("id").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place")), "numbers")
        folders = sorted(r[0] for r in numbers.select(self._block_bucket()).distinct().collect())  # a number for each bucket at most
        blocks = self._stored(tables, "postings").where(F.col("bucket").isin(folders) & (F.col("gram") == TEXTS)).select("block", F.posexplode("texts").alias("place", "_text_id"))
        found = kept(blocks.join(numbers, ["block", "place"]).select("_text_id").distinct(), "texts")
        dropped(numbers)
        return found

    def search(self, query: str, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
        """The rows one of whose indexed columns holds the query. A query shorter than
        three characters has no trigram: all rows are scanned. An empty index is an error."""
        low = query.lower()
        tables = self.tables.record()
        rows = self._stored(tables, "rows")
        if rows is None:
            raise LookupError(f"nothing indexed in {self.folder}")
        grams = trigrams(low)
        if grams:
            found = self.postings(grams, tables)
            counts = {r[0]: r[1] for r in found.groupBy("gram").agg(F.sum("n")).collect()} if found is not None else {}  # one row a trigram of the query
            if len(counts) < len(grams):
                rows = rows.limit(0)
            else:
                rare = sorted(grams, key=lambda g: (counts[g], g))[:USED]
                ids = found.where(F.col("gram").isin(rare)).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare))
                near = self._texts_of(ids, tables).withColumn("bucket", hashed("_text_id", self.buckets))
                places = sorted(r[0] for r in near.select("bucket").distinct().collect())  # a number for each bucket at most
                rows = rows.where(F.col("bucket").isin(places)).join(near.select("_text_id"), "_text_id", "left_semi") if places else rows.limit(0)
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
        out = rows.where(hit).drop("_text_id", "bucket", "batch")
        out = out.orderBy(*order_by) if order_by else out
        return out if limit is None else out.limit(limit)


def entities_found(index: TrigramIndex, query: str, limit: int = 10) -> DataFrame:
    """(name, documents) as ``store.search_entities`` gives them, from an index of
    nodes (label, document_id, ...) by label."""
    docs = F.array_sort(F.collect_set("document_id"))
    return index.search(query).groupBy(F.col("label").alias("name")).agg(docs.alias("documents")).orderBy("name").limit(limit)


def relationships_found(index: TrigramIndex, query: str, limit: int = 10) -> DataFrame:
    """As ``store.search_relationships``, from an index of edges by src, predicate and dst."""
    return index.search(query).select("src", "predicate", "dst").distinct().orderBy("src", "predicate", "dst").limit(limit)
