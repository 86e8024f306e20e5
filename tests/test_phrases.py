"""Phrases, key phrases and topics on corpora with planted ones."""

import random

import pytest

from weftline.operators import phrases as P


def corpus(spark, rows):
    return spark.createDataFrame(rows, "document_id long, text string")


def test_planted_phrases(spark):
    """What stands together by more than chance is found, a frequent pair of frequent words is not."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(30)] + ["the"] * 6
        rng.shuffle(body)
        if i % 6 == 0:
            body[10:10] = ["New", "york", "CITY"]
        rows.append((i, " ".join(body)))
    got = {r.phrase: r for r in P.phrases(corpus(spark, rows)).collect()}
    assert {"new york", "york city", "new york city"} <= set(got)
    assert got["new york city"].words == 3 and got["new york city"]["count"] == 50 and got["new york city"].npmi > 0.9
    assert "the the" not in got and all(r.npmi >= P.NPMI and r.g2 >= P.G2 for r in got.values())


def test_segments_and_empty(spark):
    """Marks and line ends part phrases; null, empty and wordless texts have none; counts below the least go."""
    rows = [(i, "blue sky, red\nsea blue sky") for i in range(3)] + [(7, None), (8, ""), (9, "?! -")]
    g = {(r.n, r.gram): r["count"] for r in P.grams(corpus(spark, rows)).groupBy("n", "gram").count().collect()}
    assert g[2, "blue sky"] == 6 and (2, "sky red") not in g and (2, "red sea") not in g and g[3, "sea blue sky"] == 3
    assert [r.phrase for r in P.phrases(corpus(spark, rows), least=6, npmi=0.0, g2=0.0).collect()] == ["blue sky"]
    for none in ([], rows[3:], [(1, "one")]):
        mined = P.phrases(corpus(spark, none))
        assert mined.count() == 0 and P.key_phrases(corpus(spark, none), mined).count() == 0
    with pytest.raises(ValueError):
        P.phrases(corpus(spark, rows), longest=1)


def test_key_phrases(spark):
    """A phrase of every document weighs nothing; of equals the first by alphabet."""
    rows = [(i, "common thing") for i in range(6)] + [(6, "common thing. odd cat. odd cat. fine dog"), (7, "common thing. odd cat. fine dog")]
    mined = spark.createDataFrame([("common thing", 2), ("odd cat", 2), ("fine dog", 2)], "phrase string, words int")
    got = [(r.document_id, r["rank"], r.phrase, r.tf, r.df) for r in P.key_phrases(corpus(spark, rows), mined, n=2).collect() if r.document_id > 5]
    assert sorted(got) == [(6, 1, "odd cat", 2, 2), (6, 2, "fine dog", 1, 2), (7, 1, "fine dog", 1, 2), (7, 2, "odd cat", 1, 2)]


def test_topics(spark):
    """Documents drawn from two vocabularies are told apart; a wordless one has no topic."""
    rng = random.Random(1)
    kinds = [[f"sea{i}" for i in range(12)], [f"ore{i}" for i in range(12)]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(40))) for i in range(80)] + [(80, None)]
    got = {r.document_id: r for r in P.topics(corpus(spark, rows), k=2, most_documents=0.9).collect()}
    assert len(got) == 81 and list(got[80].topics) == [] and got[80].share == 0
    for i in range(80):
        assert all(w.startswith(("sea", "ore")[i % 2]) for w in got[i].topics) and got[i].share > 0.9, got[i]


def test_only_phrases_leave_their_document(spark, monkeypatch):
    """Counts in pieces are those of all n-grams written out; rows that repeat an id count together, and what is
    no phrase is not sent on."""
    rng = random.Random(8)
    rows = [(i % 50, " ".join(rng.choice(["Red", "sea", "öl", "x1", "it's", "a_b", "end.", "tab\tbed", "²"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(60, None), (61, "")]
    docs = corpus(spark, rows)
    monkeypatch.setattr(P, "PIECE", 7)
    monkeypatch.setattr(P, "HELD", 20)
    want = {(r.n, r.gram): r["count"] for r in P.grams(docs).groupBy("n", "gram").count().collect()}
    got = {(r.n, r.gram): r["count"] for r in P.counted(docs, 3, "text").collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert {n: got[n, None] for n in (1, 2, 3)} == {n: sum(c for (k, _), c in want.items() if k == n) for n in (1, 2, 3)}
    wanted = spark.createDataFrame([("red sea",), ("x1 öl sea",)], "gram string")
    met = P.phrases_met(docs, wanted, 3, "document_id", "text").groupBy("document_id", "gram").sum("tf").collect()
    plain = P.grams(docs).where("gram in ('red sea', 'x1 öl sea')").groupBy("document_id", "gram").count().collect()
    assert {tuple(r) for r in met if r.gram in ("red sea", "x1 öl sea")} == {tuple(r) for r in plain}
    assert len({r.gram for r in met}) < 10 < len(want)


def test_rare_ngrams_are_not_sent_on(spark, monkeypatch):
    """With a least count hardly any n-gram below it becomes a string, and all others have their count, also where
    no window or piece holds enough of them, words are cut by pieces and blanks differ."""
    rng = random.Random(4)
    words = ["a", "über", "x²", "longerword" * 5, "ｆｕｌｌ", "é", "𝟘𝟙"]
    rows = [(i, rng.choice([" ", "\t", "  \t "]).join(rng.choice([*words, *(f"w{rng.randrange(1 << 40):x}" for _ in range(4)), "end\n", ". "]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, " \t"), (503, "one")]
    docs = corpus(spark, rows)
    want = {(r.n, r.gram): r["count"] for r in P.grams(docs).groupBy("n", "gram").count().collect()}
    for held, piece in ((P.HELD, P.PIECE), (15, 9), (200, 1)):
        monkeypatch.setattr(P, "HELD", held)
        monkeypatch.setattr(P, "PIECE", piece)
        got = {(r.n, r.gram): r["count"] for r in P.counted(docs, 3, "text", 4).collect()}
        every = {n: got.pop((n, None)) for n in (1, 2, 3)}
        assert every == {n: sum(c for (k, _), c in want.items() if k == n) for n in (1, 2, 3)}
        frequent = {k for k, c in want.items() if c >= 4}
        assert {k: got[k] for k in frequent} == {k: want[k] for k in frequent} and all(want[k] == c for k, c in got.items())
        assert len(got) < 1.1 * len(frequent) < 0.1 * len(want)
    wanted = spark.createDataFrame([(g,) for n, g in frequent if n > 1], "gram string")
    met = {(r.document_id, r.gram): r.tf for r in P.phrases_met(docs, wanted, 3, "document_id", "text").groupBy("document_id", "gram").agg({"tf": "sum"}).withColumnRenamed("sum(tf)", "tf").join(wanted, "gram").collect()}
    assert met == {(r.document_id, r.gram): r["count"] for r in P.grams(docs).join(wanted, "gram").groupBy("document_id", "gram").count().collect()}
