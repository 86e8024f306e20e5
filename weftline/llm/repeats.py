"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document; windows whose words
also start in a document with a smaller id are removed.

1. One pass over all documents: each window is filed under the least hash of the
   8-word phrases in it (winnowing), so equal windows are filed alike, and a
   document has one run of windows for about every twenty words.
2. Exact copies of a text count once: of equal texts the smallest id stands for
   all. A phrase that only one text files windows under is done with.
3. Confirmation: windows under the other phrases are counted by hash with the
   smallest and the largest id; those of two documents are recurring passages.
   Their words are taken from the document with the smallest id.
4. Phrases are dealt over shards, many to a shard, so that one has POOLED windows
   on average. A shard compiles one Aho-Corasick automaton over the words of all
   its phrases' passages, and all stretches of documents filed under any of these
   are streamed through, which finds every occurrence by the words themselves. A
   shard that happens to get more than SHARD_WINDOWS windows has a second automaton.
   A task holds one shard's at a time. Every document was read whole to file its
   stretches; a stretch under no recurring phrase has no occurrence and stays behind.
5. A phrase of more than HOT documents is dealt over several shards by document:
   its passages go to each of these, its stretches to one. Passages leave their first
   document once, are dealt over all tasks and copied there.
6. A wide phrase, one of more than SHARD_WINDOWS / 2 different recurring windows,
   is dealt by window hash too, into shards of about that many windows, so no
   automaton outgrows SHARD_WINDOWS. Its stretches go to the shards of their own
   windows. A shard of a wide phrase has up to SHARD_WINDOWS / 2 documents, so that
   dealing by document does not multiply its passages.

Texts are shuffled once to meet their recurring phrases; after that only the
documents that have any go on. Aggregates combine before they shuffle, and joins
on a phrase or a text's hash have plain exchanges on both sides, so that a hot key
is split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, text_bytes, width, written

PHRASE = 8
HOT = 256
#: Windows of an automaton. Their words are numbered by characters, and 50 words each are fewer than there are characters.
SHARD_WINDOWS = 8_000
#: Rows that a task holds before it sends them, and copies of a passage that one row becomes.
ROWS, COPIES = 4_096, 64
#: Windows and stretches that a shard of many phrases has on average.
POOLED, POOLED_STRETCHES = SHARD_WINDOWS // 8, 65_536
NOT_WIDE = -1
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * M1 + b * M2
    return x ^ (x >> np.uint64(32))


def stretch_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive words, from hashes of 1, 2, 4 ... words."""
    out, length, power, size = None, 0, h, 1
    while size <= n:
        if n & size:
            if out is None:
                out, length = power, size
            else:
                k = len(h) - length - size + 1
                out, length = joined(out[:max(k, 0)], power[length:length + max(k, 0)]), length + size
        k = len(h) - 2 * size + 1
        power, size = joined(power[:max(k, 0)], power[size:size + max(k, 0)]), 2 * size
    return out


def least_of(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n successive values."""
    m, size = g, 1
    while 2 * size <= n:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return np.minimum(m[:len(g) - n + 1], m[n - size:])


def filed(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows filed alike: (phrase hash, first window, last window)."""
    phrase = min(PHRASE, window)
    m = least_of(stretch_hashes(h, phrase), window - phrase + 1)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[lo].view(np.int64), lo, np.append(lo[1:], len(m)) - 1


def lists(rows, kind):
    return pa.array(rows, pa.list_(kind))


def profile(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_words, sha, phrases, lo, hi) of every document with an id."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                ws = text.split()
                plain = b" ".join(ws)
                one = (xxhash.xxh3_128_digest(plain), len(ws), hashlib.sha256(plain).hexdigest())
                out.append((*one, *filed(word_hashes(ws), window)) if len(ws) >= window else (*one, None, None, None))
            th, n, sha, a, lo, hi = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(th, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), lists(a, pa.int64()), lists(lo, pa.int32()), lists(hi, pa.int32())], ["id", "text_hash", "n_words", "sha", "phrases", "lo", "hi"])

    return source(docs, id_col, text_col).mapInArrow(skip_empty(run), "id long, text_hash binary, n_words long, sha string, phrases array<long>, lo array<int>, hi array<int>")


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))


def skip_empty(run):
    return lambda batches: run(b for b in batches if b.num_rows)


def dealt_stretches(docs: DataFrame, found: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(the documents with recurring phrases: id, text_hash, text; what shards
    hold: shard, kind (0: passage, 1: stretch), id, text_hash, at, words)."""
    long = found.where(F.col("n_words") >= window)
    first = long.groupBy("text_hash").agg(F.min("id").alias("id"))
    own = written(long.select("id", "text_hash", "phrases", "lo", "hi").join(first, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]), "own")
    often = own.select(F.explode(F.array_distinct("phrases")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1")
    often = written(often, "often")
    runs = own.select("id", "text_hash", F.explode(F.arrays_zip("phrases", "lo", "hi")).alias("r")).select("id", "text_hash", F.col("r.phrases").alias("phrase"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    listed = runs.join(often, "phrase").groupBy("id", "text_hash").agg(F.collect_list(F.struct("phrase", "n", "lo", "hi")).alias("runs"))
    listed = written(listed, "listed")
    met = written(source(docs, id_col, text_col).join(listed, "id"), "met")
    discard(own, listed)

    def hashes(batches):
        for b in batches:
            for i, th, text, runs in zip(*(b.column(c).to_pylist() for c in ("id", "text_hash", "text", "runs"))):
                ws = text.split()
                if xxhash.xxh3_128_digest(b" ".join(ws)) != th:  # another text under the same id
                    continue
                h = stretch_hashes(word_hashes(ws), window).view(np.int64)
                lo, n = (np.array([r[k] for r in runs], np.int64) for k in ("lo", "hi"))
                n = n - lo + 1
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                phrase = np.repeat(np.array([r["phrase"] for r in runs], np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(phrase), pa.array(h[at]), pa.array(np.full(len(at), i)), pa.array(at.astype(np.int32))], ["phrase", "h", "id", "at"])

    windows = met.select("id", "text_hash", "text", "runs").mapInArrow(hashes, "phrase long, h long, id long, at int")
    passages = windows.groupBy("phrase", "h").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min_by("at", "id").alias("at")).where("id < last")
    passages = written(passages.select("phrase", "id", "at"), "passages")
    starts = written(passages.groupBy("id").agg(F.collect_list("at").alias("starts")), "starts")
    # (id, text_hash, wide): how many windows the wide ones among a document's phrases have; as a rule none has any.
    weighed = passages.groupBy("phrase").agg(F.count("*").alias("windows"))
    load = weighed.join(often, "phrase").where(F.col("windows") <= SHARD_WINDOWS // 2).agg(F.sum(F.col("windows") * F.ceil(F.col("n") / HOT)), F.sum("n")).first()
    pools = max(16 * width(docs.sparkSession), (load[0] or 0) // POOLED, (load[1] or 0) // POOLED_STRETCHES)
    counted = written(weighed.where(F.col("windows") > SHARD_WINDOWS // 2), "wide")
    discard(passages, often)
    if counted.isEmpty():
        known = met.join(starts, "id", "left").withColumn("wide", F.lit(None).cast("map<long,long>"))
    else:
        of_wide = met.select("id", "text_hash", F.explode("runs.phrase").alias("phrase")).distinct().join(counted, "phrase")
        of_wide = written(of_wide.groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "windows"))).alias("wide")), "of_wide")
        known = met.join(starts, "id", "left").join(of_wide, ["id", "text_hash"], "left")
    hot, part = HOT, SHARD_WINDOWS // 2

    def texts(batch, *columns):
        """(id, text_hash, words, the other columns...) of a batch, without other texts under the same id."""
        for i, th, text, *other in zip(*(batch.column(c).to_pylist() for c in ("id", "text_hash", "text", *columns))):
            ws = text.split()
            if xxhash.xxh3_128_digest(b" ".join(ws)) == th:
                yield i, th, ws, *other

    def spread_of(phrase, n, wide):
        return -(-n // (part if phrase in wide else hot))

    def cut_of(h, phrase, wide):
        return (h % np.uint64(-(-wide[phrase] // part))).astype(np.int64)

    def in_batches(make):
        def run(batches):
            for b in batches:
                rows = []
                for row in make(b):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield dealt_rows(rows)
                        rows = []
                if rows:
                    yield dealt_rows(rows)

        return run

    def passages_of(b):
        """Each passage once, with the number of shards that it goes to."""
        for i, th, ws, runs, starts, wide in texts(b, "runs", "starts", "wide"):
            starts, wide = np.array(sorted(starts), np.int64), dict(wide or [])
            h = stretch_hashes(word_hashes(ws), window) if wide else None
            for r in runs:
                phrase, spread = r["phrase"], spread_of(r["phrase"], r["n"], wide)
                own = starts[np.searchsorted(starts, r["lo"]):np.searchsorted(starts, r["hi"], "right")]
                if phrase in wide:
                    to = cut_of(h[own], phrase, wide)
                    yield from ((phrase, c, spread, 0, i, th, p, b" ".join(ws[p:p + window])) for p, c in zip(own.tolist(), to.tolist()))
                elif len(own):
                    for piece in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        p, q = int(piece[0]), int(piece[-1])
                        yield phrase, NOT_WIDE, spread, 0, i, th, p, b" ".join(ws[p:q + window])

    def stretches_of(b):
        """Each stretch, for the one shard of its phrase and cut that its document has."""
        for i, th, ws, runs, wide in texts(b, "runs", "wide"):
            wide = dict(wide or [])
            h = stretch_hashes(word_hashes(ws), window) if wide else None
            mix = xxhash.xxh64_intdigest(str(i)) >> 8
            for r in runs:
                lo, hi, phrase = r["lo"], r["hi"], r["phrase"]
                cuts = np.unique(cut_of(h[lo:hi + 1], phrase, wide)).tolist() if phrase in wide else [NOT_WIDE]
                words = b" ".join(ws[lo:hi + window])
                yield from ((phrase, c, mix % spread_of(phrase, r["n"], wide), 1, i, th, lo, words) for c in cuts)

    shape = "phrase long, cut long, part long, kind int, id long, text_hash binary, at int, words binary"
    once = known.where("starts is not null").select("id", "text_hash", "text", "runs", "starts", "wide").mapInArrow(in_batches(passages_of), shape)
    stretches = known.select("id", "text_hash", "text", "runs", "wide").mapInArrow(in_batches(stretches_of), shape)
    dealt = replicated(once, width(docs.sparkSession)).unionByName(stretches)
    shard = F.when(F.col("cut") == NOT_WIDE, F.pmod(F.xxhash64("phrase", "part"), F.lit(pools))).otherwise(F.xxhash64("phrase", "cut", "part"))
    return met.select("id", "text_hash", "text"), dealt.select(shard.alias("shard"), "kind", "id", "text_hash", "at", "words")


def replicated(passages: DataFrame, tasks: int) -> DataFrame:
    """Passages for each of their shards: ``part`` is their number, and becomes 0 and
    up. They are dealt over all tasks in blocks of COPIES before they are made many, so the
    task of a hot passage's first document sends it once for a block."""
    blocks = passages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("part") - 1) / COPIES))))
    blocks = blocks.repartition(4 * tasks, "phrase", "id", "at", "block")
    first = F.col("block") * COPIES
    return blocks.withColumn("part", F.explode(F.sequence(first, F.least(first + COPIES, F.col("part")) - 1))).drop("block")


def removed_spans(docs: DataFrame, found: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(the documents with recurring phrases: id, text_hash, text; spans of words
    to remove from these: id, text_hash, spans array of (begin, end))."""
    spark = docs.sparkSession
    met, dealt = dealt_stretches(docs, found, window, id_col, text_col)
    largest = SHARD_WINDOWS

    def locate(batches):
        shard, machines = None, []
        for b in batches:
            rows = []
            for s, kind, i, th, at, words in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    shard, machines = s, [Machine(window)]
                ws = words.split(b" ")
                if kind == 0:
                    if machines[-1].full(len(ws) - window + 1, largest):
                        machines.append(Machine(window))
                    machines[-1].add(ws, i)
                    continue
                rows += [(i, th, at + x, at + y) for machine in machines for x, y in machine.spans(ws, i)]
            if rows:
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["id", "text_hash", "begin", "end"])

    dealt = dealt.repartition(4 * width(spark), "shard").sortWithinPartitions("shard", "kind")
    spans = dealt.mapInArrow(locate, "id long, text_hash binary, begin int, end int")
    return met, spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def dealt_rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["phrase", "cut", "part", "kind", "id", "text_hash", "at", "words"])


class Machine:
    """An Aho-Corasick automaton over the words of a shard's windows. Passages are
    added before the first stretch is searched."""

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.machine, self.letters, self.ready = window, ahocorasick.Automaton(), {}, False

    def full(self, more: int, largest: int) -> bool:
        """Whether it has windows and ``more`` would make them more than ``largest``."""
        return 0 < len(self.machine) and len(self.machine) + more > largest

    def add(self, words: list[bytes], first: int) -> None:
        number = self.letters.setdefault
        text = "".join(letter(number(w, len(self.letters))) for w in words)
        for k in range(len(text) - self.window + 1):
            self.machine.add_word(text[k:k + self.window], first)

    def spans(self, words: list[bytes], own: int):
        """(begin, end) of words under windows whose first document comes before ``own``."""
        if not len(self.machine):
            return
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        text, span = "".join(letter(self.letters.get(w, -1)) for w in words), None
        for end, first in self.machine.iter(text):
            if first < own:
                x, y = end - self.window + 1, end + 1
                if span and x <= span[1]:
                    span[1] = y
                else:
                    if span:
                        yield span
                    span = [x, y]
        if span:
            yield span


def letter(i: int) -> str:
    """A character for each word number; -1 (a word of no passage) has its own."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 0x801)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every document with an
    id. Words are what stands between ASCII white space. Every word that is covered
    by a window which also starts in a document with a smaller id is removed;
    windows are judged on the input. kept: the words that stay, joined by one
    space; null where nothing was removed. kept_sha256 is always given.

    Null, empty and blank texts: no words, nothing removed. Texts shorter than a
    window lose nothing. Texts of any length are judged whole, in one task each; their
    stretches go to shards apart. Rows without an id are left out and count for nothing.
    Rows that repeat an id are judged one by one and remove nothing from each
    other. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = written(profile(docs, window, id_col, text_col), "profile")
    met, spans = removed_spans(docs, found, window, id_col, text_col)

    def cut(batches):
        for b in batches:
            rows = []
            for i, th, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                ws = text.split()
                if xxhash.xxh3_128_digest(b" ".join(ws)) != th:
                    continue
                stay = np.ones(len(ws), bool)
                for s in spans:
                    stay[s["begin"]:s["end"]] = False
                kept = b" ".join(w for w, k in zip(ws, stay.tolist()) if k)
                rows.append((i, th, int((~stay).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if rows:
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()))], ["id", "text_hash", "n_removed", "kept_sha256", "kept"])

    changed = met.join(spans, ["id", "text_hash"]).select("id", "text_hash", "text", "spans").mapInArrow(cut, "id long, text_hash binary, n_removed long, kept_sha256 string, kept string")
    changed = written(changed.dropDuplicates(["id", "text_hash"]), "changed")
    copies = written(found.where(F.col("n_words") >= window).groupBy("text_hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("text_hash", "first"), "copies")
    met_all = found.select("id", "text_hash", "n_words", "sha").join(copies, "text_hash", "left").join(changed, ["id", "text_hash"], "left")
    copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return met_all.select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
