"""Phrases, key phrases and topics of a corpus, from all its texts.

Words are letters and digits, lower-cased; anything but blanks and tabs between them
ends a segment, and a phrase lies within one. An n-gram is a phrase where, at every
place at which it may be cut in two, its halves meet more often than chance has it:
by normalised pointwise mutual information (how much, -1 to 1) and by the likelihood
ratio G2 of the two-by-two table (how surely). Counts are over the whole corpus,
combined in each task before they are shuffled; nothing is sampled. Most n-grams
stand once or twice, so a first pass counts their hashes, and only those whose hash
is frequent enough become strings and are counted as such. The frequent
n-grams are written, the two joins that follow are on halves of these only. A
document's phrases are counted where the document is, past a filter of bounded size
that lets all phrases through, so only phrases and a few others are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import ngrams
from weftline.operators.iterate import kept, text_batches

#: At one degree of freedom a G2 of 10.83 comes by chance once in a thousand.
LONGEST, LEAST, NPMI, G2 = 3, 5, 0.3, 10.83
#: N-grams that a task holds before it counts them and sends them on, and bytes of texts that it takes at a time.
HELD, PIECE = 2_000_000, 1 << 20
#: Most bits of a filter that n-grams are looked up in.
FILTER_BITS = 1 << 28


def segments(text: Column) -> Column:
    """Arrays of words, one a segment."""
    cut = F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}\x20\x09]+", -1)
    return F.transform(cut, lambda s: F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), 0))


def grams(docs: DataFrame, longest: int = LONGEST, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, n, gram): every n-gram of 1 to ``longest`` words, as often as it
    stands. Null and wordless texts have none; rows that repeat an id are all counted."""
    s = docs.select(F.col(id_col).alias("document_id"), F.explode(segments(F.col(text_col))).alias("w")).where(F.size("w") > 0)

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    some = F.flatten(F.array(*map(of, range(1, longest + 1))))
    return s.select("document_id", F.inline(some))


def lines(text: Column) -> Column:
    """The text with a line for each segment, its words apart by blanks and tabs."""
    return F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}\x20\x09]+", "\n")


def read(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """(t, *more): the texts' ``lines``, each with a line end."""
    return text_batches(docs.select(F.concat(lines(F.col(text_col)), F.lit("\n")).alias("t"), *more).where("t is not null"))


def passes(hashes: DataFrame) -> np.ndarray:
    """A filter that lets ``hash`` and few others through. Its bits, 32 MB at most, go
    through the driver, whatever the input."""
    many = min(max(16 * hashes.count(), 1 << 16), FILTER_BITS)
    bits = 1 << (many - 1).bit_length()
    chunk = max(bits // 64, 8)

    def run(t: pa.Table) -> pa.Table:
        bit = t["hash"].to_numpy().view(np.uint64) & np.uint64(bits - 1)
        own = np.zeros(chunk, np.uint8)
        own[(bit % np.uint64(chunk)).astype(np.int64)] = 1
        return pa.table({"at": pa.array([int(bit[0]) // chunk], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    at = F.shiftrightunsigned(F.col("hash").bitwiseAND(F.lit(bits - 1)), chunk.bit_length() - 1)
    held = np.zeros(bits // 8, np.uint8)
    for k, own in hashes.select("hash").groupBy(at.alias("chunk")).applyInArrow(run, "at int, bits binary").collect():  # 64 rows
        held[k * chunk // 8:(k + 1) * chunk // 8] = np.frombuffer(own, np.uint8)
    return held


def repeated(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """(hash): of the n-grams that stand ``least`` times or more. Only numbers of four
    bytes are shuffled, an array for each part of all hashes; of n-grams that share a
    hash none is left out."""
    held, piece, parts = HELD, PIECE, 1 << ngrams.PART_BITS

    def run(batches):
        some, many = [], 0

        def sent():
            h = np.sort(ngrams.short(np.concatenate(some)))
            first, count = ngrams.runs(h)
            h = np.repeat(h[first], np.minimum(count, least))
            some.clear()
            cut = np.searchsorted(h, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            part = np.nonzero(np.diff(cut))[0]
            own = h.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([own[cut[k]:cut[k + 1]].tobytes() for k in part], pa.binary())], ["part", "own"])

        for b in batches:
            for p in ngrams.pieces(ngrams.buffer(b.column(0))[0], longest, piece):
                for _, at, (g,) in p.grams(longest):
                    some.append(g)
                    many += len(at)
                if many > held:
                    yield from sent()
                    many = 0
        if many:
            yield from sent()

    def frequent(batches):
        now, some = None, []

        def sent():
            h = np.sort(np.frombuffer(b"".join(some), np.uint32))
            some.clear()
            first, count = ngrams.runs(h)
            found = h[first[count >= least]].astype(np.int64) + (now << 32)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["hash"])

        for b in batches:
            for part, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != now and some:
                    yield from sent()
                now = part
                some.append(own)
        if some:
            yield from sent()

    dealt = texts.select("t").mapInArrow(run, "part int, own binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(frequent, "hash long")


def counted(docs: DataFrame, longest: int, text_col: str, least: int = 1) -> DataFrame:
    """(n, gram, count) of all texts, counted in each task first: those that
    stand ``least`` times or more, and a few others whose hash passes the same filter;
    rows with a null gram have the number of all n-grams in place of a count."""
    texts = read(docs, text_col)
    spark, piece, most = docs.sparkSession, PIECE, HELD
    shared = spark.sparkContext.broadcast(passes(kept(repeated(texts, longest, least), "repeated")) if least > 1 else None)

    def run(batches):
        every = [0] * longest
        some, many, size = [], 0, 0

        def sent():
            data = np.concatenate([d for d, _ in some])
            n, begins, ends, g, h = (np.concatenate([x[k] for _, x in some]) for k in range(5))
            order = np.argsort(g)
            first, count = ngrams.runs(g[order], h[order])
            first = order[first]
            some.clear()
            yield pa.RecordBatch.from_arrays([pa.array(n[first]), ngrams.strings(data, begins[first], ends[first]), pa.array(count)], ["n", "gram", "count"])

        for b in batches:
            for p in ngrams.pieces(ngrams.buffer(b.column(0))[0], longest, piece):
                for n, at, (g, h) in p.grams(longest, 2):
                    every[n - 1] += len(at)
                    go = ngrams.passing(shared.value, g)
                    at, g, h = at[go], g[go], h[go]
                    some.append((p.data if n == 1 else p.data[:0], (np.full(len(at), n, np.int32), p.begins[at] + size, p.ends[at + n - 1] + size, g, h)))
                    many += len(at)
                size += len(p.data)
                if many > most or size > 16 * most:
                    yield from sent()
                    many = size = 0
        if some:
            yield from sent()
        yield pa.RecordBatch.from_arrays([pa.array(range(1, longest + 1), pa.int32()), pa.nulls(longest, pa.string()), pa.array(every, pa.int64())], ["n", "gram", "count"])

    return texts.mapInArrow(run, "n int, gram string, count long").groupBy("n", "gram").agg(F.sum("count").alias("count"))


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, npmi: float = NPMI, g2: float = G2, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(phrase, words, count, npmi, g2): the n-grams of two words or more that stand
    ``least`` times or more and reach both bounds at each of their cuts; the scores are
    those of the weakest cut. An empty corpus has none."""
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    found = kept(counted(docs, longest, text_col, least).where(F.col("gram").isNull() | (F.col("count") >= least)), "grams")
    totals = {r.n: r["count"] for r in found.where("gram is null and count > 0").collect()}  # ``longest`` rows
    found = found.where("gram is not null")
    if len(totals) < 2:
        return found.where("false").select(F.col("gram").alias("phrase"), F.col("n").alias("words"), "count", F.lit(0.0).alias("npmi"), F.lit(0.0).alias("g2"))
    total = F.create_map(*[F.lit(x) for n, t in totals.items() for x in (n, float(t))])
    w = F.split("gram", " ")
    cuts = found.where((F.col("n") > 1) & (F.col("count") >= least)).select("gram", "n", "count", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("at"))
    cuts = cuts.select("*", F.array_join(F.slice(w, F.lit(1), F.col("at")), " ").alias("a"), F.array_join(F.slice(w, F.col("at") + 1, F.col("n") - F.col("at")), " ").alias("b"))
    part = found.where((F.col("n") < longest) & (F.col("count") >= least))  # a half stands at least as often as the whole
    cuts = cuts.join(part.select(F.col("gram").alias("a"), F.col("count").alias("ca")), "a").join(part.select(F.col("gram").alias("b"), F.col("count").alias("cb")), "b")
    c, ca, cb = (F.col(x).cast("double") for x in ("count", "ca", "cb"))
    n = total[F.col("n")]
    p = c / n
    score = F.when(p >= 1, 1.0).otherwise(F.ln(p / ((ca / total[F.col("at")]) * (cb / total[F.col("n") - F.col("at")]))) / -F.ln(p))
    scored = cuts.select("gram", "n", "count", score.alias("npmi"), likelihood(c, ca - c, cb - c, F.greatest(F.lit(0.0), n - ca - cb + c)).alias("g2"))
    out = scored.groupBy(F.col("gram").alias("phrase"), F.col("n").alias("words"), "count").agg(F.min("npmi").alias("npmi"), F.min("g2").alias("g2"))
    return out.where((F.col("npmi") >= npmi) & (F.col("g2") >= g2))


def likelihood(both: Column, left: Column, right: Column, neither: Column) -> Column:
    """G2 of a two-by-two table."""
    n = both + left + right + neither

    def term(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.ln(k * n / (row * col))).otherwise(0.0)

    return 2 * (term(both, both + left, both + right) + term(left, both + left, left + neither) + term(right, right + neither, both + right) + term(neither, right + neither, left + neither))


def hashes(wanted: DataFrame) -> DataFrame:
    """(hash) of each ``gram`` as a whole."""

    def run(batches):
        for b in batches:
            data, at = ngrams.buffer(b.column(0))
            found = np.zeros(len(b), np.uint64)
            for p in ngrams.pieces(data, 1, len(data)):
                line = np.searchsorted(at, p.place, "right") - 1
                first, words = ngrams.runs(line)
                for n, start, (g,) in p.grams(int(words.max(initial=1))):
                    whole = np.isin(start, first[words == n])
                    found[line[start[whole]]] = g[whole]
            yield pa.RecordBatch.from_arrays([pa.array(ngrams.short(found).view(np.int64))], ["hash"])

    return wanted.select(F.concat("gram", F.lit("\n")).alias("t")).mapInArrow(run, "hash long")


def phrases_met(docs: DataFrame, wanted: DataFrame, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(document_id, gram, tf): n-grams of two words or more of each row with their
    number in it: all that are ``wanted`` (gram), and others whose hash passes the
    same filter."""
    shared = docs.sparkSession.sparkContext.broadcast(passes(hashes(wanted)))
    piece = PIECE

    def run(batches):
        for b in batches:
            data, start = ngrams.buffer(b.column(0))
            for p in ngrams.pieces(data, longest, piece):
                row = np.searchsorted(start, p.place, "right") - 1
                parts = []
                for n, at, (g, h) in p.grams(longest, 2):
                    if n > 1:
                        go = ngrams.passing(shared.value, g)
                        at, g, h = at[go], g[go], h[go]
                        parts.append((row[at], p.begins[at], p.ends[at + n - 1], g, h))
                if parts:
                    r, begins, ends, g, h = map(np.concatenate, zip(*parts))
                    order = np.lexsort((g, r))
                    first, count = ngrams.runs(r[order], g[order], h[order])
                    first = order[first]
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(r[first])), ngrams.strings(p.data, begins[first], ends[first]), pa.array(count)], ["document_id", "gram", "tf"])

    texts = read(docs, text_col, F.col(id_col).alias("document_id"))
    return texts.mapInArrow(run, f"document_id {texts.schema['document_id'].dataType.simpleString()}, gram string, tf long")


def key_phrases(docs: DataFrame, mined: DataFrame, n: int = 5, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, rank, phrase, tf, df, weight): of each document the n phrases of
    greatest weight, tf * ln(documents / df); of equals the first by alphabet. df and
    the number of documents are over the whole corpus. Documents without a phrase have
    no row. weight is rounded to nine places, so that equals are equal."""
    mined = kept(mined.select("phrase", "words"), "phrases")
    longest = mined.agg(F.max("words")).head()[0] or 2
    wanted = mined.select(F.col("phrase").alias("gram"))
    met = phrases_met(docs, wanted, longest, id_col, text_col).join(wanted, "gram", "left_semi")
    tf = kept(met.groupBy("document_id", "gram").agg(F.sum("tf").alias("tf")), "phrases-tf")
    documents = docs.select(id_col).distinct().count()
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    weight = F.round(F.col("tf") * F.ln(F.lit(float(documents)) / F.col("df")), 9)
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("weight"), "gram"))
    return tf.join(df, "gram").withColumn("weight", weight).withColumn("rank", rank).where(F.col("rank") <= n).select("document_id", "rank", F.col("gram").alias("phrase"), "tf", "df", "weight")


def topics(docs: DataFrame, k: int = 10, vocabulary: int = 20_000, least_documents: int = 2, most_documents: float = 0.5, rounds: int = 20, terms: int = 3, seed: int = 42, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, topics, share): the topic with the greatest share in each document,
    by its ``terms`` heaviest words, from latent Dirichlet allocation over all texts. Words in
    fewer than ``least_documents`` documents or more than a share of ``most_documents`` are not of
    the model, nor any beyond the ``vocabulary`` most frequent others: these bound the model, whose
    matrix is vocabulary * k numbers. Documents without a word of it have no topic and a share of 0."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    d = docs.select(F.col(id_col).alias("document_id"), F.coalesce(F.flatten(segments(F.col(text_col))), F.array().cast("array<string>")).alias("w"))
    words = CountVectorizer(inputCol="w", outputCol="features", vocabSize=vocabulary, minDF=least_documents, maxDF=most_documents).fit(d)
    vectors = kept(words.transform(d).select("document_id", "features"), "topic-vectors")
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online").fit(vectors)
    names = F.array(*[F.array(*[F.lit(words.vocabulary[i]) for i in r.termIndices]) for r in model.describeTopics(terms).orderBy("topic").collect()])  # k rows
    shares = vector_to_array("topicDistribution")
    best = F.array_max(shares)
    at = F.array_position(shares, best).cast("int") - 1
    out = model.transform(vectors).select("document_id", best.alias("share"), at.alias("at"))
    return out.select("document_id", F.when(F.col("share") > 0, names[F.col("at")]).otherwise(F.array().cast("array<string>")).alias("topics"), "share")
