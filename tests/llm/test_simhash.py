import random

import numpy as np
import xxhash

from weftline.llm import queries, simhash


def plain_fingerprint(text):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [w for w in (text or "").translate(upper).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps):
    """fps: {id: fingerprint}; least id reachable over links of 4 bits or fewer."""
    ids = sorted(fps)
    label = {i: i for i in ids}
    for _ in ids:
        moved = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and label[b] > label[a]:
                    label[b], moved = label[a], True
        if not moved:
            return label
    return label


def test_fingerprint():
    for t in ["", None, " \t\n", "one", "one two three", "A b C d", "a b c d e f g", "É é x y z", "w " * 40_000]:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_every_link_meets_in_a_cell():
    rng = random.Random(3)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        keys, of = simhash.cells(np.array([x, y], np.uint64).view(np.int64))
        assert set(keys[of == 0]) & set(keys[of == 1])


def test_forest_connects_what_is_linked():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fp = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 7) for j in range(0, 64, 9)})
    for part in (np.array(fp, np.uint64), np.array(fp[:200], np.uint64)):
        a, b = simhash.forest(part, np.array([len(part)]))
        assert len(a) < len(part)
        label = plain_components(dict(enumerate(map(int, part[:200])))) if len(part) == 200 else None
        root = {int(x): int(x) for x in part}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            assert bin(x ^ y).count("1") <= 4
            root[find(x)] = find(y)
        if label:
            for i in range(200):
                for j in range(i):
                    assert (label[i] == label[j]) == (find(int(part[i])) == find(int(part[j])))


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    fp = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(25)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")

    def found():
        root = {x: x for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in simhash.links(df).collect():
            a, b = find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in fp}

    whole = found()
    monkeypatch.setattr(simhash, "CELL", 4)
    label = plain_components(dict(enumerate(fp)))
    assert found() == whole == {x: fp[label[i]] for i, x in enumerate(fp)}


def near(docs_df):
    return {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs_df).collect()}


def test_edge_cases(docs, clashing):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words[:-1] + ["x"])), (9, None), (8, ""), (7, " \n"), (2, "one"), (1, "ONE"), (4, "one two"), (11, " ".join(words))]
    got = near(clashing(rows))
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert near(docs([])) == {}
    assert len(simhash.near_duplicates(docs([(1, "a b"), (1, "a b"), (None, "a b")])).collect()) == 2


def test_one_of_each(docs):
    words = " ".join(f"w{i}" for i in range(300))
    left = {r.doc_id for r in simhash.one_of_each(docs([(5, words), (3, words), (9, "other text of its own"), (None, words)])).collect()}
    assert left == {3, 9, None}


def test_query_on_whole_table(spark, sf):
    rows = {r.doc_id: plain_fingerprint(r.text) for r in queries.documents(spark, sf).collect()}
    want = plain_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == {i: (format(rows[i], "016x"), want[i]) for i in rows}
