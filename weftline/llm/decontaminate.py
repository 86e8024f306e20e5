"""Benchmark decontamination: n-gram seeds join passages of the corpus to test
items, then Smith-Waterman alignment scores exact, edited and paraphrased copies.

1. Test items go in blocks of BLOCK_NGRAMS distinct n-grams at most, so what is
   broadcast has a fixed bound whatever the benchmark's size; each block is held
   against all documents.
2. Seeds: every n-gram of an item, however often documents hold it. A copy with N
   successive words intact anywhere holds a seed. An item of fewer words is one
   seed of its own length, looked up in every document.
3. One pass looks the seeds up in each document. Hits of an item that lie on near
   diagonals form one passage. A passage with fewer words of the item than the
   least score asks for, each counted as often as the item has it, cannot reach
   it; the others are aligned word by word.

Documents stay in their tasks: no shuffle but of the findings, no hot key.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

N = 3
BLOCK_NGRAMS = 200_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Least alignment score, as a share of the score of a full copy.
MIN_SCORE = 0.45
#: Texts share a few words by chance, so an alignment must also be worth so many matched words, or the whole item where it has no more.
MIN_WORDS = 5

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def least_score(n: int) -> float:
    """What an alignment with an item of n words must reach."""
    return max(MIN_SCORE * MATCH * n, MATCH * min(n, MIN_WORDS))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps: (score, begin, end) of the best local
    alignment's place in the passage."""
    m = len(passage)
    cost = -GAP * np.arange(m + 1)
    prev, best = np.zeros(m + 1), (0.0, 0, 0)
    begin = np.arange(m + 1)  # where the alignment that ends here began
    for w in item:
        diag = prev[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        here = np.concatenate([[0.0], np.maximum(np.maximum(diag, up), 0.0)])
        came = np.concatenate([[0], np.where(here[1:] <= 0, np.arange(1, m + 1), np.where(diag >= up, begin[:-1], begin[1:]))])
        # a gap along the passage: the best of what stands before, less its cost
        run = here + cost
        top = np.maximum.accumulate(run)
        src = np.maximum.accumulate(np.where(run >= top, np.arange(m + 1), 0))
        flat = top - cost
        came = np.where(flat > here, came[src], came)
        here = np.maximum(here, flat)
        prev, begin = here, came
        j = int(here.argmax())
        if here[j] > best[0]:
            best = (float(here[j]), int(came[j]), j)
    return best


class Block:
    """Items (item_id, words) and their n-grams, by ids of the block's own words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64)) for i, ws in items]
        self.grams: dict[int, int] = {}
        #: n-gram -> [(item's place in the block, position in it)]
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, x) in enumerate(self.items):
            for p, g in enumerate(self.keys(x).tolist()):
                self.seeds[self.grams.setdefault(g, len(self.grams))].append((k, p))
        self.of_item = [np.unique(x, return_counts=True) for _, x in self.items]
        self.lengths = sorted({min(N, len(x)) for _, x in self.items})
        self.sorted = np.array(sorted(self.grams), np.int64)
        self.number = np.array([self.grams[g] for g in self.sorted.tolist()], np.int64)

    def keys(self, x: np.ndarray, n: int = N) -> np.ndarray:
        """n-grams of word ids as one number each, apart from those of any other n; a
        text of fewer words is one n-gram of its own length."""
        n = min(n, len(x))
        if not n:
            return np.empty(0, np.int64)
        key = np.zeros(len(x) - n + 1, np.int64)
        for k in range(n):
            key = key * np.int64(1 << 20) + x[k:len(x) - n + 1 + k] + 1
        return key

    def ids(self, ws: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of the block's n-grams, and which these are."""
        at, gram = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in self.lengths:
            if len(x) < n:
                continue
            whole = np.ones(len(x) - n + 1, bool)
            for k in range(n):
                whole &= x[k:len(x) - n + 1 + k] >= 0
            p = np.flatnonzero(whole)
            key = np.zeros(len(p), np.int64)
            for k in range(n):
                key = key * np.int64(1 << 20) + x[p + k] + 1
            i = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            found = self.sorted[i] == key
            at.append(p[found]), gram.append(self.number[i[found]])
        return np.concatenate(at), np.concatenate(gram)

    def shared(self, k: int, passage: np.ndarray) -> int:
        """Words that item k and a passage have in common, each as often as both hold it."""
        own, often = self.of_item[k]
        at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == passage], minlength=len(own)), often).sum())

    def matches(self, x: np.ndarray):
        """(item_id, score, begin, end) of the best passage for each item met."""
        at, gram = self.hits(x)
        met: dict[int, set[int]] = defaultdict(set)
        for p, g in zip(at.tolist(), gram.tolist()):
            for k, q in self.seeds[g]:
                met[k].add(p - q)
        for k, diagonals in met.items():
            item_id, item = self.items[k]
            n, best = len(item), (0.0, 0, 0)
            least = least_score(n)
            span = None
            for d in sorted(diagonals) + [None]:
                if span is not None and (d is None or d > span[1] + n):
                    lo, hi = max(0, span[0] - n // 2), min(len(x), span[1] + n + n // 2)
                    shared = self.shared(k, x[lo:hi])  # the score is no higher
                    s, b, e = align(item, x[lo:hi]) if MATCH * shared >= least else best
                    if s > best[0]:
                        best = (s, lo + b, lo + e)
                    span = None
                if d is not None:
                    span = (d if span is None else span[0], d)
            if best[0] >= least:
                yield item_id, best[0] / (MATCH * n), best[1], best[2]


def blocks(benchmark: DataFrame, item_id: str, item_text: str):
    """Blocks of items, read one after another; the driver holds one block. An item
    is never divided: one of more than BLOCK_NGRAMS words is a block by itself."""
    held, grams = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null").orderBy("i").toLocalIterator():
        ws = words(r["t"])
        if not ws:
            continue
        if held and grams + len(ws) > BLOCK_NGRAMS:
            yield Block(held)
            held, grams = [], 0
        held.append((r["i"], ws))
        grams += len(ws)
    if held:
        yield Block(held)


SCHEMA = "doc_id long, item_id long, score double, begin_word long, end_word long"


def seeded(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str):
    """Broadcasts of the blocks."""
    spark = docs.sparkSession
    prepare(spark)
    for block in blocks(benchmark, item_id, item_text):
        yield spark.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that it holds a copy of: doc_id,
    item_id, score (0 to 1, the alignment's score as a share of a full copy's),
    begin_word and end_word (the passage, in words of letters and digits).

    A copy is an alignment worth MIN_SCORE of a full copy's score and MIN_WORDS
    matched words (items of no more words: the whole item). Null or empty texts and
    items, items without a letter or digit and items without an id match nothing.
    Texts of any length are searched whole. Rows without an id are left out, rows that repeat an id are judged one by one and
    equal findings of theirs are one row. Items that repeat an id are judged one
    by one. Empty tables give an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for chosen in seeded(rows, benchmark, item_id, item_text):

        def search(batches, held=chosen):
            for b in batches:
                found = [(i, *m) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in held.value.matches(held.value.ids(words(text)))]
                if found:
                    cols = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "begin_word", "end_word"])

        part = rows.mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out.distinct() if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no copy of a test item, by the rule of
    ``contaminated``. Rows are judged one by one in their own tasks; nothing is
    shuffled. Null and empty texts stay, and so do all rows where there are no
    items. Null and repeated ids make no difference. An empty table gives an empty
    table. Columns of docs may have any name."""
    at, out = docs.columns.index(text_col), docs
    for chosen in seeded(docs, benchmark, item_id, item_text):

        def keep(batches, held=chosen):
            for b in batches:
                yield b.filter(pa.array([next(held.value.matches(held.value.ids(words(x))), None) is None for x in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
