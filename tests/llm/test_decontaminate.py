import random

import numpy as np

from weftline.llm import decontaminate as D
from weftline.llm import queries

BENCH = "item_id long, text string, doc_id string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], BENCH)


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill"


def found(docs_df, bench):
    return {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs_df, bench).collect()}


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_score():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        s, begin, end = D.align(a, b)
        assert abs(s - plain_align(a, b)) < 1e-9
        assert s == 0 or abs(plain_align(a, b[begin:end]) - s) < 1e-9


def test_copies_edits_and_clean_text(spark, clashing):
    w = ITEM.split()
    edited = list(w)
    edited[4], edited[11] = "leaps", "eight"
    filler = [f"own{i}" for i in range(500)]
    rows = [
        (1, " ".join(filler[:200] + w + filler[200:])), (2, "Before: " + " ".join(w).upper() + "!"), (3, " ".join(filler[:9] + edited + filler[9:20])),
        (4, " ".join(w[:8] + ["inserted"] + w[8:10] + w[11:])), (5, "the quick brown fox is here"), (6, " ".join(filler)), (7, None), (8, ""), (None, ITEM), (9, " ".join(filler * 60 + w)),
    ]
    got = found(clashing(rows), items(spark, [(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "seven wizards watch")]))
    assert {i for i, k in got if k == 1} == {1, 2, 3, 4, 9}
    assert {i for i, k in got if k == 4} == {1, 2, 9}  # a short item only as a whole; document 4 lacks a word of it
    assert got[1, 1] == got[2, 1] == got[9, 1] == 1.0 and got[3, 1] < 1.0


def test_often_copied_items_are_found(spark, docs):
    rows = [(i, f"start{i} {ITEM} end{i}") for i in range(120)]
    assert len(found(docs(rows), items(spark, [(1, ITEM)]))) == 120


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_NGRAMS", 20)
    other = " ".join(f"q{i}" for i in range(30))
    got = found(docs([(1, ITEM), (2, other), (3, other + " " + ITEM)]), items(spark, [(1, ITEM), (2, other), (2, other)]))
    assert set(got) == {(1, 1), (2, 2), (3, 1), (3, 2)}
    left = {r.doc_id for r in D.clean(docs([(1, ITEM), (2, other), (4, "clean text"), (5, None)]), items(spark, [(1, ITEM), (2, other)])).collect()}
    assert left == {4, 5}


def test_empty_tables(spark, docs):
    assert found(docs([]), items(spark, [(1, ITEM)])) == {}
    assert found(docs([(1, ITEM)]), items(spark, [])) == {}
    assert D.clean(docs([(1, ITEM)]), items(spark, [])).count() == 1


def test_query_on_whole_table(spark, sf):
    """Every whole copy is found, and nothing under the least score of a full alignment."""
    bench = {r.item_id: D.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: D.words(r.text) for r in queries.documents(spark, sf).collect()}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op1_decontamination(spark, sf).collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in bench.items() if x and f" {' '.join(x)} " in f" {' '.join(t)} "}
    assert whole and whole <= set(got)
    for (d, i), s in got.items():
        vocab = {}
        a, b = ([vocab.setdefault(w, len(vocab)) for w in ws] for ws in (bench[i], texts[d]))
        best = D.align(np.array(a), np.array(b))[0] / len(a)
        assert D.MIN_SCORE <= s <= best + 1e-9


def test_copies_with_every_fourth_or_fifth_word_replaced(spark, docs):
    """Three successive words at most (four of five) are intact; every broken n-gram is in no document."""
    bench = [(k, " ".join(f"i{k}w{p}" for p in range(n))) for k, n in ((14, 15), (24, 40), (34, 200), (15, 15), (25, 40), (35, 200))]
    rows = []
    for k, text in bench:
        step = k % 10
        copy = [f"new{p}" if p % step == step - 1 else w for p, w in enumerate(text.split())]
        rows.append((k, " ".join(["before"] * 20 + copy + ["after"] * 20)))
    assert set(found(docs(rows), items(spark, bench))) == {(i, i) for i, _ in rows}
    assert D.clean(docs(rows), items(spark, bench)).count() == 0


def test_items_of_one_and_two_words_in_long_texts(spark, docs):
    text = "look at seven wizards watching a zebra now today"
    bench = [(1, "seven wizards"), (2, "zebra"), (3, "seven wizards watching"), (4, "wizards seven"), (5, "look at"), (6, "$$ !"), (7, "today")]
    got = found(docs([(1, text), (2, "seven wizards"), (3, "a zebra"), (4, "Seven. Wizards " + "word " * 50_000)]), items(spark, bench))
    assert got == {(d, i): 1.0 for d, i in [(1, 1), (1, 2), (1, 3), (1, 5), (1, 7), (2, 1), (3, 2), (4, 1)]}


def plain_found(texts, bench):
    """The best alignment of each item with each whole text, without seeds."""
    out = set()
    for d, t in texts:
        for i, b in bench:
            vocab = {}
            x, y = ([vocab.setdefault(w, len(vocab)) for w in D.words(s)] for s in (b, t))
            if x and y and D.align(np.array(x), np.array(y))[0] >= D.least_score(len(x)):
                out.add((d, i))
    return out


def edited(rng, words, share):
    out = []
    for w in words:
        kind = rng.random() / share if share else 9
        if kind < 0.6:
            out.append(f"new{rng.randint(0, 10**6)}")
        elif kind < 0.8:
            out += [w, f"more{rng.randint(0, 10**6)}"]
        elif kind >= 1:
            out.append(w)
    return out


def test_recall_on_edited_copies(spark, docs):
    """Against alignment of every pair: nothing more, and nine in ten or more at each share of edited words."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    bench = [(k, " ".join(rng.choice(common) if rng.random() < 0.3 else f"i{k}w{p}" for p in range(rng.randint(6, 40)))) for k in range(30)]
    texts = []
    for share in (0.0, 0.1, 0.2, 0.3):
        for k, b in bench:
            noise = [rng.choice(common) for _ in range(60)]
            texts.append((len(texts), " ".join(noise[:30] + edited(rng, b.split(), share) + noise[30:])))
    got, want = set(found(docs(texts), items(spark, bench))), plain_found(texts, bench)
    assert got <= want and len(want) > 100
    for s in range(4):
        own = {p for p in want if p[0] // 30 == s}
        assert len(own & got) >= 0.9 * len(own), (s, len(own & got), len(own))


def test_a_word_that_repeats_is_no_reason_to_align(monkeypatch):
    """A passage is aligned only if the item's words, each as often as the item has it, can reach the least score."""
    item = "the quick brown fox of the wood jumps over a lazy dog near old mill town by night".split()
    block = D.Block([(1, item)])
    common = ("the quick brown " + "the over the of the " * 6).split()
    copy = "and the quick brown fox of the wood jumps over one lazy cat near old mill town".split()
    calls, align = [], D.align
    monkeypatch.setattr(D, "align", lambda *a: calls.append(a) or align(*a))
    assert list(block.matches(block.ids(common))) == [] and not calls
    assert [m[0] for m in block.matches(block.ids(copy))] == [1] and len(calls) == 1
    x = block.ids(common + copy)
    assert block.shared(0, x) >= align(block.items[0][1], x)[0]
