import datetime
import random
from collections import defaultdict

import pytest

from weftline.operators import analytics
from weftline.operators import analytics as A
from weftline.operators import chunk, extract, profile, query, resolve, store
from weftline.operators.query import Filter, Options


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, "p", b) for a, b in pairs], "src string, predicate string, dst string")


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(25)]
    pairs = [(rng.choice(ids[:20]), rng.choice(ids[:20])) for _ in range(22)] + [("n1", "n1"), ("n2", "n3"), ("n2", "n3"), ("n1", "missing")]
    return ids, pairs


def plain_distances(ids, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a in ids and b in ids:
            near[a].add(b), near[b].add(a)
    out = {}
    for s in ids:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [x for x in {y for f in front for y in near[f]} if x not in seen]
            seen.update((x, d) for x in front)
        out[s] = seen
    return out


def test_metrics(spark, random_graph):
    ids, pairs = random_graph
    n, e = nodes_of(spark, ids), edges_of(spark, pairs)
    inside = [(a, b) for a, b in pairs if b != "missing"]
    dist = plain_distances(ids, pairs)
    assert {(r.node_id, r.degree) for r in A.degree(n, e).collect()} == {(i, sum((a == i) + (b == i) for a, b in pairs)) for i in ids}
    assert {(r.node_id, r.component) for r in A.components(n, A.closed(n, e)).collect()} == {(i, min(dist[i])) for i in ids}
    want = {i: (len(dist[i]) - 1) / sum(dist[i].values()) if len(dist[i]) > 1 else 0.0 for i in ids}
    assert {r.node_id: r.closeness for r in A.closeness(n, e).collect()} == pytest.approx(want)
    p = {i: 1 / len(ids) for i in ids}
    out = {i: [b for a, b in inside if a == i] for i in ids}
    for _ in range(50):
        sunk = sum(p[i] for i in ids if not out[i])
        q = {i: 0.15 / len(ids) + 0.85 * sunk / len(ids) for i in ids}
        for i in ids:
            for j in out[i]:
                q[j] += 0.85 * p[i] / len(out[i])
        moved, p = sum(abs(q[i] - p[i]) for i in ids), q
        if moved < 1e-6:
            break
    got = {r.node_id: r.pagerank for r in A.pagerank(n, e).collect()}
    assert got == pytest.approx(p, abs=1e-9) and sum(got.values()) == pytest.approx(1)
    m = A.metrics(n, A.closed(n, e)).first()
    assert (m.nodes, m.edges, m.components, m.isolates) == (25, len(inside), len({min(d) for d in dist.values()}), sum(not any(i in x for x in inside) for i in ids))


def test_long_path_is_one_component(spark):
    ids = [f"{i:03d}" for i in range(70)]
    got = A.components(nodes_of(spark, ids), edges_of(spark, list(zip(ids, ids[1:]))[::-1])).collect()
    assert {r.component for r in got} == {"000"}


def test_label_propagation(spark):
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    pairs = [(x, y) for g in (a, b) for x in g for y in g if x < y] + [("a0", "b0")]
    got = {r.node_id: r.community for r in A.label_propagation(nodes_of(spark, [*a, *b, "z"]), edges_of(spark, pairs)).collect()}
    assert {got[x] for x in a} == {"a0"} and len({got[x] for x in b[1:]}) == 1 and got["z"] == "z"


def test_empty_graph(spark):
    n, e = nodes_of(spark, []), edges_of(spark, [])
    for f in (A.degree, A.components, A.closeness, A.pagerank, A.label_propagation):
        assert f(n, e).collect() == []
    assert tuple(A.density(n, e).first()) == (0, 0, 0.0, 0.0)


MENTIONS = "entity_id string, name string, type string, category string, document_id string, chunk_id int, created_at timestamp"
RELATIONS = "relationship_id string, source_entity_id string, target_entity_id string, relation string, context string, document_id string, chunk_id int, created_at timestamp"


def day(n):
    return datetime.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def tables(spark):
    m = spark.createDataFrame([
        ("1", "Dr. Ada Lovelace", "Person", "named", "d1", 0, day(1)), ("2", "Ada Lovelace", "person", "named", "d1", 1, day(5)), ("3", "ADA LOVELACE", "Person", "x", "d2", 0, day(2)),
        ("4", "Acme Inc", "org", "named", "d2", 0, day(3)), ("5", "Acme", "org", "named", "d3", 0, None), ("6", None, None, None, "d3", 0, day(9))], MENTIONS)
    r = spark.createDataFrame([
        ("r1", "1", "4", "works_at", "", "d1", 0, day(1)), ("r2", "3", "5", "works_at", "", "d2", 0, day(4)), ("r3", "1", "nobody", "knows", "", "d1", 0, day(1))], RELATIONS)
    return m, r


def test_resolution(spark, tables):
    m, r = tables
    t = resolve.resolve(m, r)
    found = {x.normalized_key: x for x in t["resolved_entities"].collect()}
    ada = found["person|ada lovelace"]
    assert (ada.name, ada.mention_count, ada.doc_count, ada.first_seen_at, ada.last_seen_at, ada.category) == ("Dr. Ada Lovelace", 3, 2, day(1), day(5), "named")
    assert found["org|acme"].mention_count == 2 and found["|"].name == ""
    (edge,) = t["resolved_relationships"].collect()
    assert (edge.weight, edge.doc_count, edge.source_resolved_id) == (2, 2, ada.resolved_id)
    assert t["resolved_relationship_mentions"].count() == 2
    again = resolve.resolve(m.unionByName(m.limit(0)).repartition(3), r)
    for k in t:
        assert {tuple(x) for x in t[k].collect()} == {tuple(x) for x in again[k].collect()}
    n, e = resolve.resolved_snapshot(t, m, ["d2"])
    assert n.count() == 2 and e.count() == 1 and {tuple(x.documents) for x in n.collect()} == {("d1", "d2"), ("d2", "d3")}
    assert [x.count() for x in resolve.resolved_snapshot(t, m, ["none"])] == [0, 0] == [x.count() for x in resolve.resolved_snapshot(t, m, [])]
    assert resolve.run_statistics(m, t).first().asDict() == {"mentions": 6, "entities": 3, "relationships": 1, "provenance": 2}
    f = spark.createDataFrame([("1", "r", None, None), ("2", "r", "fuzzy", 0.5)], "entity_id string, resolved_id string, strategy string, confidence double")
    assert {tuple(x) for x in resolve.filled_map(f).collect()} == {("1", "r", "exact", 1.0), ("2", "r", "fuzzy", 0.5)}


def test_canonical_and_simple(spark):
    n = nodes_of(spark, ["a:X  y", "a:x-y", "b:XY", "txn:K k", "a:!!", "plain", "a:lonely"])
    e = edges_of(spark, [("a:X  y", "txn:K k"), ("a:x-y", "txn:K k"), ("b:XY", "plain")])
    nodes, edges, moves = resolve.resolve_entities(n, e, synonyms={"a": {"lonely": "solo"}})
    assert {r.node_id for r in nodes.collect()} == {"a:x-y", "b:xy", "txn:K k", "a:!!", "node:plain", "a:solo"} and edges.count() == 2
    again = resolve.resolve_entities(nodes, edges)
    assert {r.node_id for r in again[0].collect()} == {r.node_id for r in nodes.collect()}
    nodes, edges, _ = resolve.resolve_simple(n, e)
    assert {r.node_id for r in nodes.collect()} == {"a:X  y", "txn:K k", "a:!!", "plain", "a:lonely"}
    assert {r.node_id for r in resolve.resolve_simple(n, e, prune=True)[0].collect()} == {"a:X  y", "txn:K k", "plain"}


def test_store_edits(spark):
    n = spark.createDataFrame([("a", "A", ["d1"]), ("b", "B", ["d1", "d2"]), ("c", "C", [])], "node_id string, label string, documents array<string>")
    e = edges_of(spark, [("b", "c"), ("a", "c"), ("b", "a")])
    n2, e2 = store.merge_nodes(n, e, "a", "b")
    assert {(r.node_id, r.label, tuple(r.documents)) for r in n2.collect()} == {("a", "A", ("d1", "d2")), ("c", "C", ())}
    assert {(r.src, r.dst) for r in e2.collect()} == {("a", "c"), ("a", "a")}
    assert [x.count() for x in store.remove_node(n, e, "b")] == [2, 1] and store.remove_edge(e, "b", "p", "c").count() == 2
    docs = {r.node_id: r.documents for r in store.link_document(store.unlink_document(n, "b", "d1"), "c", "d9").collect()}
    assert docs == {"a": ["d1"], "b": ["d2"], "c": ["d9"]}
    d = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string")
    assert {r[0] for r in store.linked_documents(d, n, "b").collect()} == {"d1", "d2"} and store.linked_documents(d, n, "b", False).count() == 1
    assert store.undirected(edges_of(spark, [("a", "b"), ("b", "a")])).count() == 1
    rel = spark.createDataFrame([(["a", "used for", "b"],), (["a", "b"],)], "relation array<string>")
    assert [tuple(r) for r in store.whole_relations(rel).collect()] == [("a", "USED_FOR", "b")]
    old = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w"), (None, "m")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w"), (None, "m")}
    assert store.insert_missing(old.where("k is not null"), new.where("k is not null"), ["k"]).count() == 3


def test_versioned_table(spark, tmp_path):
    from weftline.sources.tables import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, document_id string")
    assert t.read() is None and t.upsert(df, ["k"]) == 1
    t.upsert(df.withColumn("v", df.k.cast("string")).where("k = 2"), ["k"])
    assert {tuple(r) for r in t.read().collect()} == {(1, "a", "d1"), (2, "2", "d2")}
    t.delete_document("d1")
    assert [r.k for r in t.read().collect()] == [2] and t.versions() == [2, 3]


def test_query_options(spark):
    df = spark.createDataFrame([(1, "Ab", 5, ["x"]), (2, None, 3, ["y", "z"]), (3, "cab", None, [])], "i int, s string, n int, tags array<string>")

    def ids(*filters, **how):
        return [r.i for r in query.query(df, Options([Filter(*f) for f in filters], **how), "i").collect()]

    assert ids(("s", "like", "AB"), order_by="i") == [1, 3] and ids(("s", "eq", None)) == [2] and ids(("n", "gte", 3), ("n", "lt", 5)) == [2]
    assert ids(("s", "ne", "Ab")) == [3] and ids(("tags", "in", ["z", "q"])) == [2] and ids(("i", "in", [1, 9])) == [1] and ids(("i", "in", [])) == []
    assert ids(order_by="n") == [2, 1, 3] and ids(order_by="n", descending=True) == [1, 2, 3] and ids(order_by="i", offset=1, limit=1) == [2]
    with pytest.raises(ValueError):
        ids(("i", "near", 1))


def test_profile(spark):
    df = spark.createDataFrame([(i, str(i), ["1.5", "", "2"][i % 3], "2024-01-0%d" % (i % 3 + 1), ["yes", "0"][i % 2], None) for i in range(9)], "o int, a string, b string, c string, d string, e string")
    got = {r.name: (r.non_null, r.nulls, r.distinct, r.inferred_type, r.examples) for r in profile.column_profile(df, ["a", "b", "c", "d", "e"], "o").collect()}
    assert got["a"] == (9, 0, 9, "integer", ["0", "1", "2"]) and got["b"] == (6, 3, 2, "float", ["1.5", "2"])
    assert got["c"][3] == "date" and got["d"][3] == "bool" and got["e"] == (0, 9, 0, "string", [])
    a, b = (profile.dataset_fingerprint(x, ["a", "b"], ["o"]).first()[0] for x in (df, df.repartition(3)))
    assert a == b and len(a) == 16


def test_chunkers(spark):
    text = "intro words\n\n# One\n\n" + "alpha beta gamma. " * 30 + "\n\n## Sub\n\nshort part\n\n##### deep\nfolded\n\n# Two\n\n" + "x" * 500
    df = spark.createDataFrame([("m", text), ("p", "word " * 300), ("n", None), ("b", " \n"), ("s", "short")], "document_id string, text string")
    rows = chunk.chunk_documents(df, 200, 40).collect()
    texts = {"m": text, "p": "word " * 300, "s": "short"}
    by = defaultdict(list)
    for r in rows:
        assert texts[r.document_id][r.start:r.end] == r.content and len(r.content) <= 200 and r.content == r.content.strip()
        by[r.document_id].append(r)
    assert set(by) == {"m", "p", "s"} and {r.strategy for r in by["m"]} == {"structured_markdown"} and {r.strategy for r in by["p"]} == {"recursive"}
    for d, cs in by.items():
        cs.sort(key=lambda r: r.idx)
        covered = set().union(*(range(r.start, r.end) for r in cs))
        assert all(i in covered for i, c in enumerate(texts[d]) if not c.isspace())
        assert [r.prev_id for r in cs] == [None, *(r.chunk_id for r in cs[:-1])] and [r.next_id for r in cs] == [*(r.chunk_id for r in cs[1:]), None]
    assert any("One > Sub" in r.section or "folded" in r.content for r in by["m"])
    overlaps = [b.start < a.end for a, b in zip(by["p"], by["p"][1:])]
    assert any(overlaps)


def test_page_chunker(spark):
    pages = [f"HEAD\n\nbody {i} hyphen-\nated\n\n\n\nmore\nFOOT {i if i > 2 else ''}" for i in range(4)]
    df = spark.createDataFrame([("d", "\f".join(pages)), ("one", "only\npage"), ("l", "word " * 100)], "document_id string, text string")
    got = chunk.chunk_pages(df, 120, 20).collect()
    d = [r for r in got if r.document_id == "d"]
    assert [r.page_number for r in d] == [1, 2, 3, 4] and d[0].content == "body 0 hyphenated\n\nmore" and "FOOT 3" in d[3].content and {r.strategy for r in d} == {"page"}
    assert [r.content for r in got if r.document_id == "one"] == ["only\npage"]
    assert {r.strategy for r in got if r.document_id == "l"} == {"page+recursive"}


def test_extract(spark):
    df = spark.createDataFrame([("d", "Ada Lovelace met Charles Babbage. They worked."), ("e", "Too short"), ("n", None)], "document_id string, text string")
    n, e = extract.extracted_graph(extract.extract(df))
    assert {tuple(r) for r in e.collect()} == {("Ada Lovelace", "met", "Charles Babbage")} and "They" in {r.node_id for r in n.collect()}
    t = extract.extract(df, lambda text: (["x"], [("x", "y"), ("x", "is", "y")]))
    assert {(r.document_id, r.src, r.predicate) for r in t.collect()} == {("d", "x", None), ("d", "x", "is")}


def test_streaming_equals_batch(spark, tables, tmp_path):
    from weftline.streaming.incremental import IncrementalResolver

    m, r = tables
    inc = IncrementalResolver(spark, str(tmp_path / "state"))
    src = tmp_path / "in"
    m.where("document_id = 'd1'").write.parquet(f"{src}/a")
    inc.add(relations=r)
    stream = spark.readStream.schema(MENTIONS).parquet(f"{src}/*")

    def drain():
        q = stream.writeStream.foreachBatch(inc.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    m.where("document_id <> 'd1'").write.parquet(f"{src}/b")
    drain()
    inc.add(mentions=m)  # the same rows again change nothing
    want = resolve.resolve(m, r)
    for k, t in inc.tables().items():
        assert {tuple(x) for x in t.collect()} == {tuple(x) for x in want[k].collect()}


def test_added_nodes_are_rows_that_were_given(spark):
    none = spark.createDataFrame([], "node_id string, type string, label string, documents array<string>")
    new = spark.createDataFrame([("n", "b", "a", ["d1"]), ("n", "a", "z", ["d2"])], none.schema)
    (got,) = store.add_nodes(none, new).collect()
    assert (got.type, got.label, sorted(got.documents)) == ("a", "z", ["d1", "d2"])


def ring(spark, n, extra=()):
    pairs = [(f"n{i:02}", f"n{(i + 1) % n:02}") for i in range(n)] + list(extra)
    return spark.createDataFrame([(f"n{i:02}",) for i in range(n)] + [("alone",)], "node_id string"), spark.createDataFrame(pairs, "src string, dst string")


def test_colours_of_neighbours_differ(spark):
    nodes, edges = ring(spark, 15, [("n00", "n07"), ("n00", "n00"), ("n03", "n09"), ("n00", "n07")])
    got = dict(map(tuple, analytics.colouring(nodes, edges).collect()))
    assert all(got[r.src] != got[r.dst] for r in edges.collect() if r.src != r.dst) and max(got.values()) <= 3 and got["alone"] == 0 and len(got) == 16
    assert analytics.colouring(nodes.limit(0), edges).collect() == []


def test_labels_in_turn_do_not_oscillate(spark):
    # on a complete bipartite graph labels that move at once swap sides for ever
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node_id string")
    edges = spark.createDataFrame([(x, y) for x in "abcd" for y in "efgh"], "src string, dst string")
    assert len({r.community for r in analytics.label_propagation_in_turn(nodes, edges).collect()}) == 1
    two = spark.createDataFrame([(x, y) for s in ("abcd", "efgh") for x in s for y in s if x < y] + [("d", "e")], "src string, dst string")
    got = dict(map(tuple, analytics.label_propagation_in_turn(nodes, two).collect()))
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "efgh"}) == 1 and got["a"] != got["h"]


def test_estimated_closeness(spark):
    nodes, edges = ring(spark, 40, [(f"n{i:02}", f"n{i * 7 % 40:02}") for i in range(0, 40, 3)])
    exact = dict(map(tuple, analytics.closeness(nodes, edges).collect()))
    got = {r.node_id: r for r in analytics.closeness_estimated(nodes, edges).collect()}
    assert all(abs(got[n].closeness - c) <= 0.03 * c for n, c in exact.items()) and got["alone"].closeness == 0 and got["n00"].reached == 40


def test_a_choice_of_very_many_documents(spark):
    """Chosen documents beyond the number of literals are joined, with the same rows."""
    from weftline.operators import analytics, resolve

    nodes = spark.createDataFrame([(f"n{i}", [f"d{i}", f"d{i + 1}"] if i % 7 else []) for i in range(60)], "node_id string, documents array<string>")
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 3 % 60}", f"d{i % 20}" if i % 6 else None) for i in range(60)], "src string, dst string, document_id string")
    few = [f"d{i}" for i in range(0, 40, 5)]
    many = few + few + [f"other{i}" for i in range(resolve.LITERALS)]
    want, got = analytics.visible_subgraph(nodes, edges, few), analytics.visible_subgraph(nodes, edges, many)
    assert [sorted(map(str, d.collect())) for d in got] == [sorted(map(str, d.collect())) for d in want] and 0 < got[1].count() < 60
    assert got[1].columns == edges.columns
    one, two = resolve.among(edges, "document_id", few), resolve.among(edges, "document_id", many)
    assert sorted(one.collect()) == sorted(two.collect()) and two.columns == edges.columns and one.count() > 0
    assert resolve.among(edges, "document_id", []).count() == 0


def test_estimated_closeness_sends_no_sketch_of_a_leaf_and_broadcasts_none(spark, monkeypatch):
    """Sketches are small on disk, so that Spark would broadcast them through the driver."""
    wide, plans, kept = [], [], analytics.kept

    def watched(df, tag, **measured):
        if "ball" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = kept(df, tag, **measured)
        if "ball" in out.columns:
            wide.append(out.count())
        return out

    monkeypatch.setattr(analytics, "kept", watched)
    path = [("a", "b"), ("b", "c"), ("c", "d")]
    rays = [("a", f"l{i:03d}") for i in range(300)] + [("x", "y")]
    ids = sorted({v for e in path + rays for v in e} | {"alone"})
    nodes, edges = spark.createDataFrame([(v,) for v in ids], ["node_id"]), spark.createDataFrame(path + rays, ["src", "dst"])
    got = {r.node_id: r for r in analytics.closeness_estimated(nodes, edges).collect()}
    monkeypatch.undo()
    exact = {r.node_id: r.closeness for r in analytics.closeness(nodes, edges).collect()}
    assert max(wide) <= 6 and not any("Broadcast" in p for p in plans[1:])  # a, b, c, x, y and the one alone
    assert got.keys() == exact.keys() and all(abs(got[v].closeness - c) <= 0.05 * c for v, c in exact.items())
    assert {r.rounds for r in got.values()} == {5} and got["alone"].reached == 1 and got["y"].reached == 2


def test_rounds_keep_numbers_and_no_names(spark, monkeypatch):
    """Colouring, labels in turn and PageRank write and send longs between rounds; the
    order of names and a node without an id make no difference to what they were."""
    seen, kept = [], analytics.kept

    def watched(df, tag, **measured):
        seen.append({t for _, t in df.dtypes})
        return kept(df, tag, **measured)

    monkeypatch.setattr(analytics, "kept", watched)
    nodes = spark.createDataFrame([("b",), ("a",), ("c",), ("lone",), (None,)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "nowhere")], ["src", "dst"])
    colour = dict(map(tuple, analytics.colouring(nodes, edges).collect()))
    turn = dict(map(tuple, analytics.label_propagation_in_turn(nodes, edges).collect()))
    rank = dict(map(tuple, analytics.pagerank(nodes, edges).collect()))
    assert all("string" not in t for t in seen) and colour.keys() == turn.keys() == rank.keys() == {"a", "b", "c", "lone", None}
    assert colour["a"] != colour["b"] != colour["c"] and turn["lone"] == "lone" and turn["a"] == turn["b"] == turn["c"]
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["c"] > rank["b"] > rank["a"]
