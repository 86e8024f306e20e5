import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import langid, queries


def test_features_and_unknown():
    assert langid.features(None) is langid.features("") is langid.features("12 $$ \n") is None
    a, b = langid.features("Hello,  World"), langid.features("hello world!")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    long = langid.features("ab" * 200_000)
    assert long[1].sum() == 3 * (400_000 + 2) - 3


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = np.zeros((4000, 2))
    z[np.arange(4000), np.where(rng.random(4000) < 0.8, y, 1 - y)] = 8.0  # right four times in five, sure of it always
    t = langid.calibrated(z, y)
    assert langid.softmax(np.array([8.0, 0.0]) / t)[0] == pytest.approx(0.8, abs=0.03)


def test_held_out_rule(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id")).withColumn("h", langid.held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_edge_cases(spark, clashing, docs):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", None, "", "123", "é", "word " * 50_000])] + [(None, "the end"), (1, "the cat")]
    model = langid.fit(clashing(rows), F.lit(True))
    got = langid.predict(clashing(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (2, 3)] == ["und", "und"]
    assert {r.lang_pred for r in got} == {"en", "und"}
    none = langid.fit(docs(rows).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs(rows), none).collect()} == {("und", 0.0)}
    assert langid.predict(docs([]), langid.fit(docs([]), F.lit(True))).collect() == []
    kept = langid.identified(clashing(rows), model, 0.35)
    assert kept.columns == clashing(rows).columns and {r.text for r in kept.collect()} == {t for _, t in rows if t and any(c.isalpha() for c in t)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in queries.documents(spark, sf).collect()}
    got = [r for r in queries.op9_language_id(spark, sf).collect()]
    assert {r.doc_id for r in got} == set(lang)
    own = [r for r in got if r.held_out]
    assert len(own) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.97 * len(own)


def plain_features(text):
    """{hash of an n-gram: count} by loops over a text's characters."""
    t, out = text.lower(), {}
    clean = []
    for ch in t:
        if ch.isalpha():
            clean.append(ord(ch))
        elif not clean or clean[-1] != 32:
            clean.append(32)
    c = ([] if clean[0] == 32 else [32]) + clean + ([] if clean[-1] == 32 else [32])
    m = 0xFFFFFFFF
    for i in range(len(c)):
        g1 = c[i] * 0x9E3779B1 & m
        grams = [g1]
        if i + 1 < len(c):
            g2 = ((g1 ^ 0x5BD1E995) * 0x85EBCA6B + c[i + 1] * 0xC2B2AE35) & m
            grams.append(g2)
        if i + 2 < len(c):
            grams.append(((g2 ^ g2 >> 15) * 0x27D4EB2F + c[i + 2] * 0x165667B1) & m)
        for g in grams:
            k = ((g ^ g >> 13) * 0x9E3779B1 & m) >> 32 - langid.BITS
            out[k] = out.get(k, 0) + 1
    return out


def test_features_against_plain_loops():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aBc é1 .,\n") for _ in range(rng.randint(1, 30))) + "x"
        at, count = langid.features(text)
        assert dict(zip(at.tolist(), count.tolist())) == plain_features(text)


def plain_ftrl(rows, labels, k, d, epochs=3, alpha=0.5, beta=1.0, l1=0.002, l2=0.002):
    z, n = [[0.0] * k for _ in range(d + 1)], [[0.0] * k for _ in range(d + 1)]

    def weight(j, c):
        a, b = (0.0, 0.0) if j == d else (l1, l2)
        if abs(z[j][c]) <= a:
            return 0.0
        return -(z[j][c] - math.copysign(a, z[j][c])) / ((beta + math.sqrt(n[j][c])) / alpha + b)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = dict(zip(*(a.tolist() for a in rows[i]))) | {d: 1.0}
            w = {j: [weight(j, c) for c in range(k)] for j in x}
            s = [sum(v * w[j][c] for j, v in x.items()) for c in range(k)]
            e = [math.exp(v - max(s)) for v in s]
            for j, v in x.items():
                for c in range(k):
                    g = v * (e[c] / sum(e) - (labels[i] == c))
                    sigma = (math.sqrt(n[j][c] + g * g) - math.sqrt(n[j][c])) / alpha
                    z[j][c] += g - sigma * w[j][c]
                    n[j][c] += g * g
    return np.array([[weight(j, c) for c in range(k)] for j in range(d + 1)])


def test_ftrl_against_plain_loops():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    labels = np.array([int(at[0]) % 3 for at, _ in rows])
    for l1 in (0.002, 1.0):  # the second leaves weights at zero
        w, bias = langid.ftrl(rows, labels, 3, 12, l1=l1)
        assert np.allclose(np.vstack([w, bias]), plain_ftrl(rows, labels, 3, 12, l1=l1), atol=1e-12)
        assert (w == 0).any() == (l1 == 1.0)


@pytest.mark.parametrize("one_id", [7, None])
def test_repeated_and_null_ids_are_sampled_like_any_other(spark, docs, one_id, monkeypatch):
    rows = [(one_id, f"the cat and the dog number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(10_000)]
    rows += [(one_id, f"le chat et le chien {chr(97 + i)}", "fr") for i in range(26)] + [(one_id, f"der Hund und die Katze {chr(97 + i % 20)}", "de") for i in range(4000)]
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sizes = {}
    kept = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda x, y, *a, **k: sizes.update(n=len(x), y=sorted(set(y.tolist()))) or kept(x, y, *a, **k))
    model = langid.fit(df, F.lit(True), per_language=200)
    assert model.languages == ["de", "en", "fr"] and sizes["y"] == [0, 1, 2]
    assert 0.75 * 246 <= sizes["n"] <= 246
    assert sum(model.predict(t)[0] == g for _, t, g in rows) >= 0.99 * len(rows)


def test_hundreds_of_languages(spark):
    rng = random.Random(4)
    names = [f"l{i:03d}" for i in range(600)]
    own = {g: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for g in names}
    rows = [(i * 10 + k, " ".join(rng.choice(own[g]) for _ in range(12)), g) for i, g in enumerate(names) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, F.lit(True), per_language=6)
    assert model.languages == names
    right = sum(r.lang_pred == r.lang for r in langid.predict(df, model).join(df, "doc_id").collect())
    assert right >= 0.95 * len(rows)


def test_temperature_against_a_grid():
    rng = np.random.default_rng(8)
    for scale in (0.5, 2.0, 6.0):
        z, y = rng.normal(size=(300, 4)) * scale, rng.integers(0, 4, 300)
        z[np.arange(300), y] += 1.5

        def loss(t):
            return -np.mean([math.log(langid.softmax(a / t)[k]) for a, k in zip(z, y)])

        grid = np.exp(np.linspace(math.log(0.5), math.log(20.0), 150))
        assert loss(langid.calibrated(z, y)) <= min(map(loss, grid)) + 1e-9
    assert langid.calibrated(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
