"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then temperature calibration.

Document frequencies are counted over all training rows. The classifier is
fitted on a sample of at most PER_LANGUAGE rows a language and about SAMPLE in
all, those with the lowest hash of id and text; its features come to the driver as
packed arrays. Every language of the training rows is learned, however many there
are. The model holds the weights of the features in the sample, FEATURES x
languages at most, so it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prepare, written

BITS = 16
FEATURES = 1 << BITS
#: Sampled training rows of a language, at most.
PER_LANGUAGE = 1000
#: Sampled training rows of all languages: with more than SAMPLE / PER_LANGUAGE languages each has an equal share, of one row at least.
SAMPLE = 40_000
HELD_BACK = 5  # each fifth sampled row of a language is kept for the calibration
UNKNOWN = "und"

_letters: list = []


def letter_table() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed counts of character n-grams (1 to 3, white space and signs as one
    space): (feature numbers ascending, counts). None if the text has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    c = np.concatenate([[32], c[stay], [32] if letter[-1] else []]).astype(np.uint32)
    count = np.zeros(FEATURES, np.int64)
    for i in range(0, len(c), 1 << 16):
        x = c[i:i + (1 << 16) + 2]
        g1 = x * np.uint32(0x9E3779B1)
        g2 = (g1[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + x[1:] * np.uint32(0xC2B2AE35)
        g3 = (g2[:-1] ^ (g2[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
        n = min(1 << 16, len(c) - i)  # n-grams that begin in this part
        for g in (g1[:n], g2[:n], g3[:n]):
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0x9E3779B1)
            count += np.bincount(g >> np.uint32(32 - BITS), minlength=FEATURES)
    at = np.flatnonzero(count)
    return at, count[at]


def weighted(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[at]
    return v / np.sqrt((v * v).sum())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    place: np.ndarray  # feature -> row of weights; the last row is zero
    weights: np.ndarray  # features in the sample + 1, x languages
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return weighted(at, count, self.idf) @ self.weights[self.place[at]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text)
        if f is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*f) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list, labels: np.ndarray, n_classes: int, n_features: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of (feature numbers, values), one row at a time in an
    order fixed by a seed; the bias has no penalty."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))
    penalty1 = np.full(n_features + 1, l1)[:, None]
    penalty2 = np.full(n_features + 1, l2)[:, None]
    penalty1[-1] = penalty2[-1] = 0

    def solve(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * penalty1[at]) / ((beta + np.sqrt(ni)) / alpha + penalty2[at])
        return np.where(np.abs(zi) <= penalty1[at], 0.0, w)

    x = [(np.append(at, n_features), np.append(v, 1.0)) for at, v in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            at, v = x[i]
            w = solve(at)
            p = softmax(v @ w)
            p[labels[i]] -= 1
            g = v[:, None] * p
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    w = solve(np.arange(n_features + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm between 0.5 and 20: a small sample without errors says nothing for less."""
    if not len(labels):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    lo, hi, r = np.log(0.5), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def drawn(rows: DataFrame, per_language: int) -> tuple[DataFrame, int, dict[str, int]]:
    """rows (id, text, lang) with ``draw``, a hash of id and text; each language's
    share of the sample; and for each language a bound of draw that about twice as
    many different rows, one at least, do not exceed."""
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id", "text"), 2))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"), F.min("draw").alias("least")).orderBy("lang").collect()
    top = 1 << 62
    share = max(1, min(per_language, SAMPLE // max(1, len(counts))))
    return rows, share, {r["lang"]: max(r["least"], min(top, 2 * share * (top // max(1, r["n"])))) for r in counts}


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows where ``train`` holds and the language is not null.

    The sample has ``per_language`` different rows of each language at most, all of
    them where there are fewer; equal rows (id, text and language) count once in it,
    so neither null nor repeated ids change its size. A null text or one without a
    letter teaches nothing. No training rows: a model of no languages. Very long
    texts count by the logarithm of their n-grams like any other. Other columns are
    not read. The driver holds the sample's features (SAMPLE rows) and two numbers
    for each of these and language.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows, share, bound = drawn(rows, per_language)
    if not bound:
        return Model([], np.ones(FEATURES), np.zeros(FEATURES, np.int64), np.zeros((1, 0)), np.zeros(0), 1.0)
    languages = sorted(bound)
    limits = spark.sparkContext.broadcast(bound)  # a number a language

    def run(batches):
        seen, n, taken = np.zeros(FEATURES, np.int64), 0, set()
        for b in batches:
            out = []
            for text, lang, draw in zip(*(c.to_pylist() for c in b.columns)):
                f = features(text)
                if f is None:
                    continue
                seen[f[0]] += 1
                n += 1
                if draw <= limits.value[lang] and (lang, draw) not in taken:
                    taken.add((lang, draw))
                    out.append((draw, lang, f[0].astype("<u4").tobytes(), f[1].astype("<u4").tobytes()))
            if out:
                draw, lang, at, count = zip(*out)
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([-1] * k), pa.array([0] * k), pa.array(draw, pa.int64()), pa.array(lang), pa.array(at, pa.binary()), pa.array(count, pa.binary())], names)
        at = np.append(np.flatnonzero(seen), FEATURES)
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], n)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)

    names = ["feature", "df", "draw", "lang", "at", "count"]
    found = written(rows.select("text", "lang", "draw").mapInArrow(run, "feature long, df long, draw long, lang string, at binary, count binary"), "features")
    df = np.zeros(FEATURES + 1, np.int64)
    for r in found.where("feature >= 0").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    first = Window.partitionBy("lang").orderBy("draw")
    sample = found.where("feature < 0").dropDuplicates(["lang", "draw"]).withColumn("no", F.row_number().over(first)).where(F.col("no") <= share)
    x, y, back, number = [], [], [], {lang: k for k, lang in enumerate(languages)}
    for r in sample.select("draw", "lang", "at", "count", "no").orderBy("draw", "lang").toLocalIterator():
        x.append((np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["count"], "<u4")))
        y.append(number[r["lang"]])
        back.append(r["no"] % HELD_BACK == 0)
    discard(found)
    used = np.unique(np.concatenate([f[0] for f in x])) if x else np.empty(0, np.int64)
    place = np.full(FEATURES, len(used), np.int64)
    place[used] = np.arange(len(used))
    y, back = np.array(y, np.int64), np.array(back, bool)
    w, bias = ftrl([(place[at], weighted(at, count, idf)) for (at, count), b in zip(x, back) if not b], y[~back], len(languages), len(used))
    model = Model(languages, idf, place, np.append(w, np.zeros((1, len(languages))), axis=0), bias, 1.0)
    logits = np.array([model.logits(*f) for f, b in zip(x, back) if b]).reshape(-1, len(languages))
    model.temperature = calibrated(logits, y[back])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row a row of docs, from the whole text and
    nothing else. A null text, or one without a letter: ``und`` with score 0. Rows
    that repeat an id or have none stay. A model of no languages: all ``und``. Texts of
    any length are read whole; a task holds one text's distinct features. An empty
    table gives an empty table. Other columns are not read."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [held.value.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that have a letter and whose language has a
    probability of ``min_score`` or more. Rows are judged one by one in their own
    tasks; nothing is shuffled. Null texts and texts without a letter go, with a
    model of no languages all rows do. Null and repeated ids make no difference. An
    empty table gives an empty table. Columns of docs may have any name."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [held.value.predict(x) for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
