from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftline.operators import analytics, extract, iterate, resolve, store
from weftline.operators.query import Filter, Options
from weftline.schemas import EDGES, MENTIONS, NODES
from weftline.sources import files
from weftline.sources.tables import AppendedTable, KeyedStore, VersionedTable, create_tables, drop_tables
from weftline.store_queries import pdf
from weftline.streaming.incremental import IncrementalResolver


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_a_cluster_needs_a_shared_folder():
    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        iterate.shared_folder(made)


def test_kept_measures_in_the_same_job(spark):
    df = iterate.kept(spark.range(10), "t", n=F.count(F.lit(1)), most=F.max("id"))
    assert df.seen == {"n": 10, "most": 9} and df.count() == 10
    iterate.dropped(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(df.written_to).count()


def test_appended_table(spark, tmp_path):
    t = AppendedTable(spark, str(tmp_path / "a"), "k")
    assert t.read() is None
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string")
    t.append(df)
    t.append(df)  # the same batch again
    t.append(spark.createDataFrame([(2, "changed"), (3, "c")], "k int, v string"))
    assert [r for r in rows(t.read().where("k is not null"))] == [(1, "a"), (2, "b"), (3, "c")]
    before = {p: sorted(x.name for x in (tmp_path / "a").rglob("*.parquet")) for p in t.batches()}
    t.append(spark.createDataFrame([(4, "d")], "k int, v string"))
    assert set(before) < set(t.batches())  # nothing is written anew
    t.append(df.limit(0))
    assert t.read().where("k is not null").count() == 4


def test_touched_entities(spark, tmp_path):
    made = [("e1", "Ada", "person", "c", "d1", 0, None), ("e2", "ADA", "person", "c", "d2", 0, None), ("e3", "Acme Inc", "company", "c", "d1", 0, None)]
    m = spark.createDataFrame(made, MENTIONS)
    inc = IncrementalResolver(spark, str(tmp_path / "s"))
    inc.add(mentions=m.where("entity_id <> 'e2'"))
    inc.add(mentions=m)
    got = rows(inc.touched(m.where("entity_id = 'e2'")), "normalized_key", "mention_count", "doc_count")
    assert got == [("person|ada", 2, 2)]


def test_keyed_store(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"))
    assert s.get("x", 1) is None and s.all("x") is None and not s.exists("x", 1) and s.count("x") == 0 and not s.delete("x", 1)
    s.save("x", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string"))
    s.save("x", spark.createDataFrame([(2, "c")], "id int, v string"))
    assert rows(s.get("x", 2)) == [(2, "c")] and s.exists("x", 3) and not s.exists("x", 9)
    assert [r.id for r in s.all("x", Options([Filter("v", "ne", "a")], "v")).collect()] == [2] and s.count("x", Options([Filter("id", "gt", 1)])) == 2
    assert s.delete("x", 2) and not s.delete("x", 2) and s.count("x") == 2 and s.count("y") == 0


def test_tables_made_and_dropped(spark, tmp_path):
    kinds = {"nodes": NODES, "edges": EDGES}
    assert create_tables(spark, str(tmp_path), kinds) == ["nodes", "edges"] and create_tables(spark, str(tmp_path), kinds) == []
    t = VersionedTable(spark, f"{tmp_path}/edges")
    assert t.read().columns == EDGES.fieldNames() and t.read().count() == 0
    assert drop_tables(spark, str(tmp_path), ["edges", "none"]) == ["edges"] and t.read() is None


def test_plain_pdfs_and_problems(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(["one \\(1\\)", "two\\051"]))
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "c.xyz").write_bytes(b"?")
    (tmp_path / "d.md").write_bytes(b"text")
    got = {r.title: (r.text, r.problem) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"] == ("one (1)\ftwo)", None) and got["d"] == ("text", None) and got["c"] == ("", "no parser for this type")
    assert got["b"][0] == "" and got["b"][1]
    assert files.pdf_string(b"<48 69>") == "Hi" and files.pdf_string(b"(a\\nb\\\\)") == "a\nb\\"


def test_knowledge_base_registry(spark, tmp_path):
    path = str(tmp_path / "kb.json")
    kbs = spark.createDataFrame([("1", "o", "s", 'n "x"'), ("2", None, "t", "m")], "kb_id string, owner_id string, slug string, name string")
    files.write_knowledge_bases(kbs, path)
    assert rows(files.read_knowledge_bases(spark, path), "kb_id", "slug", "name") == [("1", "s", 'n "x"'), ("2", "t", "m")]
    files.write_knowledge_bases(kbs.limit(0), path)
    assert files.read_knowledge_bases(spark, path).count() == 0


def test_edits(spark):
    n = spark.createDataFrame([("a", "A", ["d1"]), ("b", "B", ["d2"]), ("c", None, None)], "node_id string, label string, documents array<string>")
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c")], "src string, predicate string, dst string")
    nodes, edges = store.merge_nodes(n, e, "a", "b")
    assert rows(nodes.where("documents is not null").select("node_id", "label", F.array_join("documents", ","))) == [("a", "A", "d1,d2")] and nodes.count() == 2
    assert rows(edges) == [("a", "p", "a"), ("a", "p", "c")]
    assert store.merge_nodes(n, e, "x", "y")[0].count() == 3  # neither is a node
    more = spark.createDataFrame([("a", "New", ["d3", "d1"]), ("z", "Z", None), ("z", "Y", ["d9"])], n.schema)
    got = {r.node_id: (r.label, r.documents) for r in store.add_nodes(n, more).collect()}
    assert got == {"a": ("New", ["d1", "d3"]), "b": ("B", ["d2"]), "c": (None, []), "z": ("Y", ["d9"])}
    t = spark.createDataFrame([("d7", "a", "knows", "q"), ("d7", "a", "p", "b"), ("d8", "q", None, None)], "document_id string, src string, predicate string, dst string")
    n2, e2 = store.merge_extraction(n, e, t)
    assert {r.node_id: r.documents for r in n2.collect()} == {"a": ["d1", "d7"], "b": ["d2", "d7"], "c": [], "q": ["d7", "d8"]}
    assert rows(e2) == [("a", "knows", "q"), ("a", "p", "b"), ("b", "p", "c")]
    ided = e.withColumn("id", F.lit("1"))
    assert store.add_edges(ided, ided.withColumn("dst", F.lit("other")), keys=("id",)).count() == 2


def test_synonyms_as_a_frame(spark):
    n = spark.createDataFrame([(f"a:Name {i}",) for i in range(700)] + [("txn:X y",), ("a:??",)], "node_id string")
    e = n.select(F.col("node_id").alias("src"), F.lit("p").alias("predicate"), F.lit("a:Name 1").alias("dst"))
    table = {"a": {f"name {i}": f"group {i % 7}" for i in range(700)}}
    nodes, edges, _ = resolve.resolve_entities(n, e, synonyms=table)
    want = {(f"a:group-{i}",) for i in range(7)} | {("txn:X y",), ("a:??",)}
    assert set(rows(nodes)) == want and {r.dst for r in edges.collect()} == {"a:group-1"} and edges.count() == 9
    frame = spark.createDataFrame([("a", k, v) for k, v in table["a"].items()], "prefix string, alias string, value string")
    assert rows(resolve.resolve_entities(n, e, synonyms=frame)[1]) == rows(edges)


def test_distances_of_a_long_path_and_a_ring(spark):
    n = spark.createDataFrame([(f"{i:02d}",) for i in range(24)], "node_id string")
    e = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(11)] + [(f"{12 + i:02d}", f"{12 + (i + 1) % 12:02d}") for i in range(12)], "src string, dst string")
    got = {(r.source, r.node_id): r.distance for r in analytics.distances(n, e).collect()}
    want = {(f"{i:02d}", f"{j:02d}"): abs(i - j) for i in range(12) for j in range(12)}
    want |= {(f"{i:02d}", f"{j:02d}"): min((i - j) % 12, (j - i) % 12) for i in range(12, 24) for j in range(12, 24)}
    assert got == want


def test_routed_extraction(spark):
    short, long = "Ada Lovelace met Charles Babbage. " * 4, "Ada Lovelace met Charles Babbage. Then Grace Hopper wrote. " * 60
    d = spark.createDataFrame([("s", short), ("l", long), ("n", None), ("x", "tiny")], "document_id string, text string")
    t = extract.extract_routed(d, limit=200, size=200, overlap=50)
    assert {(r.document_id, r.route) for r in t.collect()} == {("s", "document"), ("l", "chunk")}
    one = {r.document_id: r for r in extract.by_document(t).collect()}
    assert one["s"].entities == ["Ada Lovelace", "Charles Babbage"] and ["Ada Lovelace", "met", "Charles Babbage"] in one["l"].relations and "Grace Hopper" in " ".join(one["l"].entities)
