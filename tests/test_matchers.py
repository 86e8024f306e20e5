import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import matchers, resolve, similar, vectors
from weftline.schemas import MENTIONS, RELATIONS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(seed, n, alphabet="abcé"):
    rng = random.Random(seed)
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 10))) for _ in range(n)]
    return sorted(set(made) | {m[:3] + "x" + m[4:] for m in made[::5]} | {"", "a", "ab", "\U0001f511a"})


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_pairs_are_all_pairs(spark, k):
    own = names(k, 120)
    df = spark.createDataFrame([("t", x) for x in own] + [("u", x) for x in own[::2]] + [("t", None), (None, "abc"), (None, "abd"), ("t", own[0])], "block string, name string")
    got = sorted(map(tuple, similar.edit_pairs(df, k, split=20).collect()))
    want = [(t, a, b, distance(a, b)) for t, some in (("t", own), ("u", own[::2]), ("", ["abc", "abd"])) for a, b in itertools.combinations(some, 2) if distance(a, b) <= k]
    assert got == sorted(want) and len(got) > 30
    assert similar.edit_pairs(df.limit(0), k).collect() == []


def test_few_pairs_meet_and_a_hot_key_is_split(spark):
    rng = random.Random(5)
    own = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)})
    df = spark.createDataFrame([("t", x) for x in own], "block string, name string")
    assert similar.edit_candidates(df).count() < 0.02 * len(own) * (len(own) - 1) / 2
    # a third of all names begin with the same rare pair at the same place
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, f"n{i}") for i in range(3000)], "k int, x string")
    dealt, sent = similar.parted(left, left.withColumnRenamed("x", "y"), ["k"], "x", 50)
    assert dealt.count() == 3000 and dealt.groupBy("k", "part").count().agg(F.max("count")).head()[0] < 100
    assert dealt.join(sent, ["k", "part"]).where("x <> y").count() == 1000 * 999


def test_hardly_more_meet_than_are_one_edit_apart(spark):
    """Names of a few common stretches, short ones and ones about SHORT characters long."""
    rng = random.Random(9)
    parts = ["ing", "tion", "the", "ed", "er", "sch", "ung"]
    own = {"".join(rng.choices(parts, k=rng.choice((2, 3, 4, 12, 13)))) for _ in range(500)}
    own |= {x[:i] + y + x[i + 1:] for x in list(own)[:150] for i, y in [(rng.randrange(len(x)), rng.choice(["", "q"]))]}
    own = sorted(own)
    df = spark.createDataFrame([("t", x) for x in own], "block string, name string")
    want = {(a, b) for a, b in itertools.combinations(own, 2) if abs(len(a) - len(b)) < 2 and distance(a, b) <= 1}
    assert {(r.a, r.b) for r in similar.edit_pairs(df, 1).collect()} == want and len(want) > 100
    assert any(len(a) <= similar.SHORT < len(b) for a, b in map(lambda p: sorted(p, key=len), want))
    assert similar.edit_candidates(df.where(f"length(name) <= {similar.SHORT}")).count() < 2 * len(want)


def test_set_pairs(spark):
    rng = random.Random(7)
    rows = [(i, rng.choices("abcdefghijkl", k=rng.randint(0, 9))) for i in range(150)] + [(900, None), (901, []), (902, ["q", None]), (903, ["q"])]
    df = spark.createDataFrame(rows, "id long, members array<string>")
    classes, roots = similar.set_classes(df)
    sets = {i: frozenset(x for x in m or [] if x) for i, m in rows}
    root = {}
    for i in sorted(sets):
        root.setdefault(sets[i], i)
    assert dict(map(tuple, classes.collect())) == {i: root[s] for i, s in sets.items()}
    for least in (0.5, 0.8, 1.0):
        want = {(root[a], root[b]) for a, b in itertools.combinations(root, 2) if a | b and len(a & b) / len(a | b) >= least - 1e-12}
        got = similar.set_pairs(roots, least, split=10).collect()
        assert {(r.a, r.b) for r in got} == {(min(p), max(p)) for p in want} and len(got) == len(want)
    assert similar.set_pairs(roots.limit(0), 0.5).collect() == []


def plain_stars(weight, pairs):
    near = {}
    for a, b, d in pairs:
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    order = sorted(weight, key=lambda x: (-weight[x], x))
    rank, centres = {x: i for i, x in enumerate(order)}, set()
    for x in order:
        if not any(y in centres for _, y in near.get(x, [])):
            centres.add(x)
    return {x: (x, 0) if x in centres else min(((d, rank[y], y) for d, y in near[x] if y in centres))[::-2] for x in order}


def test_stars_cut_chains(spark):
    rng = random.Random(11)
    weight = {f"n{i:03}": rng.randint(1, 3) for i in range(120)}
    pairs = sorted({(*sorted(rng.sample(sorted(weight), 2)), rng.randint(1, 2)) for _ in range(150)})
    pairs = list({(a, b): (a, b, d) for a, b, d in pairs}.values()) + [(f"c{i}", f"c{i + 1}", 1) for i in range(30)]
    weight |= {f"c{i}": 1 for i in range(31)}
    nodes, links = spark.createDataFrame(list(weight.items()), "node string, weight long"), spark.createDataFrame(pairs, "a string, b string, distance int")
    got = {r.node: (r.centre, r.distance) for r in similar.stars(nodes, links).collect()}
    want = plain_stars(weight, pairs)
    assert got == {x: (c, d) for x, (c, d) in want.items()}
    assert len({c for n, (c, _) in got.items() if n.startswith("c")}) > 9  # not one chain
    assert {r.node for r in similar.stars(nodes, links.limit(0)).collect()} == set(weight)


def mentions(spark):
    rows = [("e1", "Acme Holding"), ("e2", "acme holding"), ("e3", "Acme Holdin"), ("e4", "Acme Holdi"), ("e5", "Zeta"), ("e6", None)]
    return spark.createDataFrame([(e, n, "company", "c", f"d{k % 2}", 0, None) for k, (e, n) in enumerate(rows)], MENTIONS)


def test_fuzzy_resolution(spark):
    relations = spark.createDataFrame([("r1", "e3", "e5", "owns", "", "d0", 0, None), ("r2", "e1", "e5", "owns", "", "d1", 0, None)], RELATIONS)
    found = resolve.resolve(mentions(spark), relations, matcher=matchers.FuzzyMatcher(k=1))
    to = {r.entity_id: (r.resolved_id, r.strategy, round(r.confidence, 3)) for r in found["entity_resolution_map"].collect()}
    assert to["e1"] == to["e2"] and to["e1"][0] == to["e3"][0] != to["e4"][0]  # two edits from the centre: an entity of its own
    assert to["e1"][1:] == ("exact", 1.0) and to["e3"][1:] == ("fuzzy", round(1 - 1 / 12, 3))
    entities = {r.normalized_key: r.mention_count for r in found["resolved_entities"].collect()}
    assert entities == {"company|acme holding": 3, "company|acme holdi": 1, "company|zeta": 1, "company|": 1}
    assert [r.weight for r in found["resolved_relationships"].collect()] == [2]


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    made = np.vstack([base] + [base[:30] + s * rng.standard_normal((30, 16)) for s in (0.1, 0.2, 0.4)])
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(500, made[3].tolist()), (501, None), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1e200] * 16)]
    classes, roots = vectors.vector_classes(spark.createDataFrame(rows, "id long, vector array<double>"))
    assert {r.id: r.root for r in classes.collect()} == {**{i: i for i in range(len(made))}, 500: 3, 504: 504}
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    s = unit @ unit.T
    for least in (0.7, 0.9):
        want = {(a, b) for a, b in zip(*np.nonzero(s >= least)) if a < b}
        exact = {(r.a, r.b) for r in vectors.exact_pairs(roots, least, block=25).collect()}
        got = {(r.a, r.b) for r in vectors.similar_pairs(roots, least, recall=0.95, bits=10, split=10).collect()}
        assert exact == want and got <= want and len(got) >= 0.9 * len(want) and len(want) > 50
    assert vectors.similar_pairs(roots.limit(0), 0.9).collect() == []


def test_tables_reach_the_recall_they_are_made_for():
    for cosine, bits in ((0.9, 12), (0.5, 6), (0.8, 20)):
        n = vectors.tables_for(cosine, bits, 16, 0.95)
        assert 1 - (1 - vectors.meeting(cosine, bits, 16, seed=9)) ** n > 0.93
    with pytest.raises(ValueError):
        vectors.tables_for(0.1, 60, 4, 0.99)


def test_embedding_resolution(spark):
    m = mentions(spark)
    of = spark.createDataFrame([("e1", [1.0, 0.0]), ("e4", [2.0, 0.1]), ("e5", [0.0, 1.0]), ("e3", None)], "entity_id string, vector array<double>")
    for exact in (False, True):
        to = {r.entity_id: (r.resolved_id, r.strategy) for r in matchers.EmbeddingMatcher(of, 0.95, exact).map(m).collect()}
        assert to["e1"] == to["e4"] and to["e1"][1] == "embedding" and to["e5"] != to["e1"] and to["e3"][1] == "exact" and set(to) == {f"e{i}" for i in range(1, 7)}


def test_a_recall_of_one_leaves_no_pair_out(spark):
    """Several blocks, products in steps, vectors of two lengths, pairs of a block with itself."""
    rng = np.random.default_rng(3)
    v = [*rng.standard_normal((2_500, 12)), *rng.standard_normal((300, 5))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    want = set()
    for a, b in ((0, 2_500), (2_500, 2_800)):
        u = np.array([x / np.sqrt(x @ x) for x in v[a:b]])
        x, y = np.nonzero(np.triu(u @ u.T >= 0.8, 1))
        want |= set(zip((x + a).tolist(), (y + a).tolist()))
    got = [(r.a, r.b) for r in vectors.similar_pairs(vectors.vector_classes(df)[1], 0.8, recall=1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1_000


def test_word_sets_that_cannot_be_similar_are_not_sent_on(spark):
    """Sets on either side of SMALL_SET and of the lengths that are compared: no pair is
    lost, and of random ones that share their rarest words hardly any goes on."""
    rng = random.Random(5)
    rows = []
    for n in (3, 40, 360, 495, 505, 700):
        base = rng.sample(range(4_000), n)
        rows += [base, base[: int(n * 0.85)], base[: int(n * 0.72) + 1], base[: int(n * 0.6)], base[1:] + [4_000 + n]]
    rows += [rng.sample(range(4_000), 300) for _ in range(120)]
    sets = spark.createDataFrame([(i, [str(v) for v in x]) for i, x in enumerate(rows)], "id long, members array<string>")
    roots = similar.set_classes(sets)[1].cache()
    own = {r.root: set(r.members) for r in roots.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.7}
    assert {(r.a, r.b) for r in similar.set_pairs(roots, 0.7, split=20).collect()} == want and len(want) > 30
    assert similar.set_candidates(roots, 0.7).count() < 2 * len(want)
    roots.unpersist()


def test_large_sets_and_groups_of_near_copies(spark, monkeypatch):
    """Sketches grow with their sets, so large ones that share a third do not go on; of near copies a set goes to
    a task once, not once for each of its pairs. Ids may be of any kind; equal by brute force."""
    rng = random.Random(6)
    rows = [rng.sample(range(6_000), 3_000) for _ in range(30)] + [rng.sample(range(6_000), 40) for _ in range(30)]
    rows += [rows[3][:2_400], rows[3][:2_999] + [9_000], rows[40][:28], rows[40][:27]]
    rows += [[*range(7_000, 7_060), 8_000 + i] for i in range(60)]  # 1,770 pairs
    roots = similar.set_classes(spark.createDataFrame([(f"d{i:03}", [str(v) for v in x]) for i, x in enumerate(rows)], "id string, members array<string>"))[1].cache()
    own = {f"d{i:03}": set(x) for i, x in enumerate(rows)}
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in itertools.combinations(sorted(own), 2)}
    want = {p: s for p, s in want.items() if s >= 0.7}
    assert similar.set_candidates(roots, 0.7).count() < len(want) + 20 and len(want) > 1_770
    got = similar.set_pairs(roots, 0.7).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
    met = similar.set_candidates(roots, 0.7).collect()
    seen = []
    keep = similar.kept
    monkeypatch.setattr(similar, "kept", lambda df, tag, **m: seen.append((tag, keep(df, tag, **m))) or seen[-1][1])
    similar.set_pairs(roots, 0.7, split=32).collect()
    pairs = dict(seen)["pairs"]
    sent = pairs.select(F.explode(F.array("a", "b")).alias("root"), "g", "h").distinct().count()
    assert len(met) == pairs.count() and sent < 0.3 * len(met)
    roots.unpersist()
