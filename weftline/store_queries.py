"""Registered queries of sources, the catalogue, the store's edits, plans and
streams. Files that a query reads are first written from its table into the
folder that driver and executors share."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions import names, texts
from weftline.functions import normalizers as N
from weftline.operators import catalog, graph, profile, resolve, store
from weftline.operators.iterate import shared_folder
from weftline.operators.query import Filter, Options
from weftline.plans import ontology
from weftline.plans.mapping import MappingSpec
from weftline.queries import BASE_SQL, MENTIONS_SQL, ONTOLOGY, ORDER_SPEC, SLUG, base_graph, mentions, registered, relations, table, with_documents
from weftline.schemas import EDGES, MENTIONS, NODES
from weftline.sources import files
from weftline.sources.tables import KeyedStore, VersionedTable, create_tables, drop_tables
from weftline.streaming.incremental import IncrementalResolver, event_counts


def folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/query-{tag}-{uuid.uuid4().hex}"


def put(spark, path: str, data: bytes) -> None:
    with files.created(spark, path) as write:
        write(data)


# -- files ------------------------------------------------------------------------


def nation_csv(spark, sf_dir, sep: str) -> str:
    path = folder(spark, "csv")
    n = table(spark, sf_dir, "nation")
    n.select("n_nationkey", F.concat("n_name", F.lit(', "so called"')).alias(" note "), "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey").write.csv(path, sep=sep, header=True, escape='"')
    return path


NATION_CELLS = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', \"so called\"' AS note, n_regionkey::VARCHAR AS n_regionkey FROM nation"


@registered(NATION_CELLS)
def csv_sniffed(spark, sf_dir):
    """A file with semicolons, quotes and blanks in a header, by its sniffed delimiter."""
    return files.read_csv(spark, nation_csv(spark, sf_dir, ";"))


@registered(f"{NATION_CELLS} ORDER BY nation.n_nationkey LIMIT 7")
def csv_first_rows(spark, sf_dir):
    return files.read_csv(spark, nation_csv(spark, sf_dir, "\t"), limit=7)


@registered("""
SELECT o_orderkey::VARCHAR AS k, CASE o_orderkey % 3 WHEN 1 THEN 'he said "' || o_orderstatus || '"; ok' ELSE '' END AS a,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_custkey::VARCHAR ELSE o_orderstatus END AS b FROM orders""")
def csv_ragged(spark, sf_dir):
    """Orders as rows of one, three and five cells, some quoted: short rows are
    filled, long ones cut, and the files are read in parts."""
    path, kind = folder(spark, "ragged"), F.col("o_orderkey") % 3
    said = F.concat(F.lit('"he said ""'), "o_orderstatus", F.lit('""; ok";'), F.col("o_custkey").cast("string"), F.lit(";extra;more"))
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.when(kind == 1, said).when(kind == 2, F.concat(F.lit(";"), "o_orderstatus")))
    table(spark, sf_dir, "orders").select(line.alias("k ;a; b")).write.csv(path, header=True, sep="\x01", quote="\x00", escapeQuotes=False)
    return files.read_csv(spark, path, ";")


@registered("SELECT * FROM (VALUES ('|', 0, 'n_nationkey', 5), ('|', 1, 'note', 5), ('|', 2, 'n_regionkey', 5)) v(delimiter, place, header, rows)")
def csv_head(spark, sf_dir):
    """Delimiter, headers and a sample in one call."""
    delimiter, headers, rows = files.read_head(spark, nation_csv(spark, sf_dir, "|"), 5)
    n = rows.count()
    return spark.createDataFrame([(delimiter, i, h, n) for i, h in enumerate(headers)], "delimiter string, place int, header string, rows int")


@registered("SELECT unnest([',', ';', '|', chr(9)]) AS written, unnest([',', ';', '|', chr(9)]) AS found")
def csv_delimiters(spark, sf_dir):
    return spark.createDataFrame([(d, files.sniff_csv(spark, nation_csv(spark, sf_dir, d))) for d in files.DELIMITERS], "written string, found string")


def docx(lines: list[str]) -> bytes:
    z = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return z.getvalue()


def pdf(pages: list[str]) -> bytes:
    """A plain PDF, a page a text."""
    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages):
        stream = f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode()
        out += b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj\n" % (2 * i + 1, 2 * i + 2)
        out += b"%d 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (2 * i + 2, len(stream), stream)
    return out + b"trailer <<>>\n%%EOF"


def nation_files(spark, sf_dir) -> str:
    """A file for each nation, of five types by its key, in a folder for each region."""
    path = folder(spark, "files")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        kind = ("md", "txt", "csv", "docx", "bin")[r.n_nationkey % 5]
        line = f"{r.n_name} of {r.n_regionkey}"
        data = {"csv": f"name;region\n{r.n_name};{r.n_regionkey}\n".encode(), "docx": docx([line, "end"]), "bin": b"\0"}.get(kind, line.encode())
        put(spark, f"{path}/region{r.n_regionkey}/nation{r.n_nationkey}.{kind}", data)
    return path


LOADED_SQL = """
n AS (SELECT *, n_name || ' of ' || n_regionkey AS line, ['md', 'txt', 'csv', 'docx', 'bin'][n_nationkey % 5 + 1] AS kind FROM nation),
f AS (SELECT 'nation' || n_nationkey AS title, upper(kind) AS file_type, n_nationkey,
  CASE kind WHEN 'csv' THEN 'name=' || n_name || ', region=' || n_regionkey WHEN 'docx' THEN line || chr(10) || 'end' WHEN 'bin' THEN '' ELSE line END AS text, 'pending' AS status,
  CASE WHEN kind = 'bin' THEN 'no parser for this type' END AS problem FROM n)"""


@registered(f"WITH {LOADED_SQL} SELECT title, file_type, status, text, problem FROM f")
def documents_loaded(spark, sf_dir):
    """Files below a folder by the parsers of their types; an unknown type says so."""
    return files.read_documents(spark, nation_files(spark, sf_dir)).select("title", "file_type", "status", "text", "problem")


@registered(f"WITH {LOADED_SQL} SELECT title, text FROM f WHERE file_type = 'MD'")
def documents_by_pattern(spark, sf_dir):
    return files.read_documents(spark, nation_files(spark, sf_dir), "*.md").select("title", "text")


@registered(f"""
WITH {LOADED_SQL} SELECT count(*) FILTER (WHERE n_nationkey % 2 = 1 AND text <> '') AS ok, count(*) FILTER (WHERE n_nationkey % 2 = 1 AND text = '') AS failed, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS skipped FROM f""")
def ingest_summary(spark, sf_dir):
    """Known files are left out before they are parsed."""
    path = nation_files(spark, sf_dir)
    found = files.read_documents(spark, path)
    known = found.where(F.regexp_extract("title", "[0-9]+", 0).cast("int") % 2 == 0).select("file_path")
    return files.ingest_summary(found, known, files.read_documents(spark, path, known=known))


@registered("SELECT 'nation' || n_nationkey AS title, upper(n_name) AS text FROM nation")
def parser_registered(spark, sf_dir):
    path = folder(spark, "own")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        put(spark, f"{path}/nation{r.n_nationkey}.own", r.n_name.encode())
    files.register_parser("own", lambda data: data.decode().upper())
    return files.read_documents(spark, path).select("title", "text")


@registered("SELECT 'region' || n_regionkey AS title, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS page_number, n_name || ' (' || n_nationkey || ')' AS page FROM nation")
def pdf_pages(spark, sf_dir):
    """A PDF for each region with a page for each nation."""
    path, by = folder(spark, "pdf"), {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows at any scale
        by.setdefault(r.n_regionkey, []).append(f"{r.n_name} \\({r.n_nationkey}\\)")
    for k, pages in by.items():
        put(spark, f"{path}/region{k}.pdf", pdf(pages))
    docs = files.read_documents(spark, path)
    return files.file_pages(docs).join(docs.select("document_id", "title"), "document_id").select("title", "page_number", "page")


@registered(f"""
SELECT DISTINCT 'customer:' || o_custkey AS src, 'placed' AS predicate, 'order:' || o_orderkey AS dst FROM orders
UNION SELECT 'order:' || o_orderkey, 'has_priority', 'priority:' || {SLUG.format('o_orderpriority')} FROM orders""")
def graph_lines_round_trip(spark, sf_dir):
    path = folder(spark, "lines")
    files.write_graph_json(*graph.graph(table(spark, sf_dir, "orders"), ORDER_SPEC), path)
    return files.read_graph_lines(spark, path)[1]


@registered("""
WITH x AS (SELECT 'nation:' || n_nationkey AS id FROM nation UNION SELECT 'region:' || n_regionkey FROM nation), r AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation)
SELECT 'entity' AS kind, row_number() OVER (ORDER BY id) - 1 AS place, id AS src, NULL AS predicate, NULL AS dst FROM x
UNION ALL SELECT 'relation', row_number() OVER (ORDER BY src, dst) - 1, src, 'in', dst FROM r""")
def graph_document(spark, sf_dir):
    """One JSON document, entities and relations sorted, as it stands in the file."""
    n = table(spark, sf_dir, "nation")
    spec = MappingSpec.of({"entities": {"N": {"key": {"prefix": "nation:", "column": "n_nationkey"}}, "R": {"key": {"prefix": "region:", "column": "n_regionkey"}}}, "edges": [{"predicate": "in", "source": {"entity": "N"}, "target": {"entity": "R"}}]})
    path = f"{folder(spark, 'document')}.json"
    files.write_graph_document(*graph.graph(n, spec), path)
    raw = spark.read.schema("entities array<string>, relations array<array<string>>").json(path, multiLine=True)
    none = F.lit(None).cast("string")
    e = raw.select(F.posexplode("entities").alias("place", "src")).select(F.lit("entity").alias("kind"), F.col("place").cast("long").alias("place"), "src", none.alias("predicate"), none.alias("dst"))
    r = raw.select(F.posexplode("relations").alias("place", "r")).select(F.lit("relation").alias("kind"), F.col("place").cast("long").alias("place"), F.col("r")[0].alias("src"), F.col("r")[1].alias("predicate"), F.col("r")[2].alias("dst"))
    return e.unionByName(r)


@registered("SELECT DISTINCT 'nation:' || n_nationkey AS src, 'in' AS predicate, 'region:' || n_regionkey AS dst FROM nation")
def graph_document_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node_id"))
    edges = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.lit("in").alias("predicate"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"))
    path = f"{folder(spark, 'document')}.json"
    files.write_graph_document(nodes, edges, path)
    return files.read_graph_json(spark, path)[1]


@registered(f"""
WITH {BASE_SQL}
SELECT DISTINCT 'entity' AS kind, node_id AS src, NULL AS predicate, NULL AS dst FROM nodes UNION ALL SELECT DISTINCT 'relation', src, predicate, dst FROM edges""")
def graph_documents_round_trip(spark, sf_dir):
    """The whole customer-order graph as many JSON documents, read back."""
    nodes, edges, _ = base_graph(spark, sf_dir)
    path = folder(spark, "documents")
    files.write_graph_documents(nodes, edges, path)
    n, e = files.read_graph_json(spark, path, lines=True)
    none = F.lit(None).cast("string")
    return n.select(F.lit("entity").alias("kind"), F.col("node_id").alias("src"), none.alias("predicate"), none.alias("dst")).unionByName(e.select(F.lit("relation").alias("kind"), "src", "predicate", "dst"))


@registered(f"SELECT DISTINCT unnest(['customer:' || o_custkey, 'order:' || o_orderkey, 'priority:' || {SLUG.format('o_orderpriority')}]) AS node_id FROM orders")
def mapping_from_json(spark, sf_dir):
    path = f"{folder(spark, 'mapping')}.json"
    put(spark, path, json.dumps(ORDER_SPEC.to_dict()).encode())
    return graph.nodes(table(spark, sf_dir, "orders"), files.read_mapping(spark, path))


@registered("SELECT 'kb' || n_nationkey AS kb_id, 'owner' || n_regionkey AS owner_id, lower(n_name) AS slug, n_name AS name FROM nation WHERE n_regionkey = 2")
def knowledge_bases_json(spark, sf_dir):
    """A registry written and read back; those of one owner."""
    n = table(spark, sf_dir, "nation")
    kbs = n.select(F.concat(F.lit("kb"), "n_nationkey").alias("kb_id"), F.concat(F.lit("owner"), "n_regionkey").alias("owner_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    path = f"{folder(spark, 'registry')}.json"
    files.write_knowledge_bases(kbs, path)
    return files.read_knowledge_bases(spark, path).where("owner_id = 'owner2'").select("kb_id", "owner_id", "slug", "name")


# -- tables -----------------------------------------------------------------------


@registered("SELECT * FROM (VALUES ('edges', 'made'), ('nodes', 'made'), ('edges', 'dropped'), ('nodes', 'dropped'), ('nodes', 'made again')) v(name, what)")
def tables_made_and_dropped(spark, sf_dir):
    path, kinds = folder(spark, "tables"), {"nodes": NODES, "edges": EDGES}
    rows = [(n, "made") for n in create_tables(spark, path, kinds)] + [(n, "made twice") for n in create_tables(spark, path, kinds)]
    rows += [(n, "dropped") for n in drop_tables(spark, path, ["nodes", "edges", "other"])] + [(n, "made again") for n in create_tables(spark, path, {"nodes": NODES})]
    return spark.createDataFrame(rows, "name string, what string")


@registered("SELECT 'nodes' AS name, 'c' || c_custkey AS node_id FROM customer UNION ALL SELECT 'again', 'n' || c_custkey FROM customer")
def tables_filled_and_dropped(spark, sf_dir):
    """Tables made, filled with all customers, made once more (which leaves them as
    they are), one dropped with its rows and filled anew."""
    path, kinds = folder(spark, "tables"), {n: StructType([StructField("node_id", StringType())]) for n in ("nodes", "again")}
    c, at = table(spark, sf_dir, "customer"), lambda name: VersionedTable(spark, f"{path}/{name}")
    create_tables(spark, path, kinds)
    for name in kinds:
        at(name).write(c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id")))
    create_tables(spark, path, kinds)
    drop_tables(spark, path, ["again"])
    create_tables(spark, path, kinds)
    new = at("again").read().unionByName(c.select(F.concat(F.lit("n"), "c_custkey").alias("node_id")))
    at("again").write(new)
    return at("nodes").read().select(F.lit("nodes").alias("name"), "node_id").unionAll(at("again").read().select(F.lit("again").alias("name"), "node_id"))


@registered("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, true AS known FROM customer WHERE c_custkey <> 7""")
def keyed_store(spark, sf_dir):
    """Saved, saved again in part, one deleted; then all rows, and whether the first is found."""
    s = KeyedStore(spark, folder(spark, "store"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s.save("customer", c)
    s.save("customer", c.where("id % 2 = 0").withColumn("name", F.upper("name")))
    gone = s.delete("customer", 7) and not s.delete("customer", 7) and not s.exists("customer", 7) and s.count("customer") == s.all("customer").count()
    return s.all("customer").withColumn("known", F.lit(gone and s.get("customer", 1).count() == 1))


@registered("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 12 OFFSET 3")
def keyed_store_options(spark, sf_dir):
    s = KeyedStore(spark, folder(spark, "store"))
    s.save("customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"))
    return s.all("customer", Options([Filter("c_acctbal", "gt", 5000)], "c_acctbal", True, 3, 12)).select("id")


@registered("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3")
def versioned_delete(spark, sf_dir):
    t = VersionedTable(spark, folder(spark, "events"))
    t.write(table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("d"), F.col("event_id") % 10).alias("document_id")))
    t.delete_document("d3")
    return t.read().select("event_id", "event_type")


# -- catalogue --------------------------------------------------------------------


@registered("""
SELECT 'd' || (c_custkey // 2) AS document_id, max(c_name) AS title FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1""")
def documents_saved(spark, sf_dir):
    """Insert or replace by id; rows of an unknown type are not taken."""
    c = table(spark, sf_dir, "customer")
    d = c.select(F.concat(F.lit("d"), F.expr("c_custkey div 2")).alias("document_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "XLS").otherwise("CSV").alias("file_type"), F.col("c_custkey").alias("n"))
    one = catalog.save_documents(d.limit(0), d.where("n % 2 = 0"))
    return catalog.save_documents(one, d.where("n % 2 = 1")).select("document_id", "title")


@registered("SELECT 'd' || o_custkey AS document_id, max(o_orderkey) AS stamp FROM orders GROUP BY 1")
def profiles_saved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), "o_custkey").alias("document_id"), F.col("o_orderkey").alias("stamp"))
    low = o.groupBy("document_id").agg(F.min("stamp").alias("stamp"))
    return catalog.save_profiles(low, o.groupBy("document_id").agg(F.max("stamp").alias("stamp")))


@registered("SELECT o_custkey AS ontology_id, max(o_orderkey) AS mapping FROM orders GROUP BY 1")
def mappings_saved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ontology_id"), F.col("o_orderkey").alias("mapping"))
    return catalog.save_mappings(o.groupBy("ontology_id").agg(F.min("mapping").alias("mapping")), o.groupBy("ontology_id").agg(F.max("mapping").alias("mapping")))


@registered("""
SELECT l_orderkey AS document_id, 'c' || l_orderkey || '_' || l_linenumber AS chunk_id, 'old' AS content FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 2)
UNION ALL SELECT DISTINCT l_orderkey, 'c' || l_orderkey || '_' || l_linenumber, 'new' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 2""")
def chunks_saved(spark, sf_dir):
    """A document's chunks come anew: all it had go."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("c"), "l_orderkey", F.lit("_"), "l_linenumber").alias("chunk_id"), F.lit("old").alias("content"), "l_linenumber")
    new = c.where("document_id % 2 = 0 and l_linenumber <= 2").withColumn("content", F.lit("new"))
    return catalog.save_chunks(c, new).select("document_id", "chunk_id", "content")


@registered("SELECT p_partkey AS file_path FROM part WHERE p_partkey % 3 <> 0")
def documents_new(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_path"))
    return catalog.new_documents(p.where("file_path % 3 = 0"), p)


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = 1)")
def knowledge_base_found(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("owner_id", F.concat(F.lit("o"), "n_regionkey")).withColumn("slug", F.lower("n_name"))
    first = n.where("n_regionkey = 1").agg(F.min("slug")).first()[0]
    return catalog.knowledge_base(n, first, "o1").select("n_nationkey", "n_name")


@registered("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def ontologies_deleted(spark, sf_dir):
    return catalog.delete_where(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey")


@registered(f"""
WITH {BASE_SQL}, c AS (SELECT DISTINCT node_id, label FROM nodes WHERE type = 'customer') SELECT 'card:' || node_id AS card_id, 'u1' AS user_id, label AS front FROM c ORDER BY node_id LIMIT 10""")
def first_cards(spark, sf_dir):
    n, _, _ = base_graph(spark, sf_dir)
    return catalog.cards_of(n.where("type = 'customer'").select("node_id", "label").distinct(), "u1")


@registered("SELECT event_id AS card_id FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def cards_by_domain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user, two = e.agg(F.min("user_id")).first()[0], [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return catalog.cards_by_domain(e.select(F.col("event_id").alias("card_id"), "user_id", F.array("event_type").alias("domains")), user, two).select("card_id")


@registered("SELECT event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND ts::DATE >= (SELECT max(ts)::DATE FROM events) - 7")
def recent_reviews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user, now = e.agg(F.min("user_id"), F.max("ts")).first()
    return catalog.recent_reviews(e.withColumnRenamed("ts", "reviewed_at"), user, F.lit(now)).select("event_id")


@registered("SELECT 10 AS n, 10 AS known")
def random_rows(spark, sf_dir):
    """Ten different rows of the table, whichever they are."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    return profile.sample_rows(p, 10).distinct().join(p, "p_partkey").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("known"))


# -- edits ------------------------------------------------------------------------

DOCS_SQL = "g AS (SELECT node_id, list_sort(list(DISTINCT document_id)) AS documents FROM nodes GROUP BY 1)"


def joined(df):
    return df.select("node_id", F.array_join(F.array_sort("documents"), ",").alias("documents"))


@registered(f"""
WITH {BASE_SQL}, {DOCS_SQL} SELECT node_id, array_to_string(CASE WHEN node_id = 'customer:1' THEN list_sort(list_distinct(list_append(documents, 'docX'))) ELSE documents END, ',') AS documents FROM g
UNION ALL SELECT 'new:1', 'docY'""")
def nodes_added(spark, sf_dir):
    """A new node, and one more document of a known one."""
    new = spark.createDataFrame([("customer:1", ["docX"]), ("new:1", ["docY"])], "node_id string, documents array<string>")
    return joined(store.add_nodes(with_documents(base_graph(spark, sf_dir)[0]), new))


@registered(f"WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges UNION SELECT 'customer:1', 'knows', 'customer:2'")
def edges_added(spark, sf_dir):
    """One that is new, one that is known and one with an end that is no node."""
    n, e, _ = base_graph(spark, sf_dir)
    e = e.select("src", "predicate", "dst").distinct()
    more = spark.createDataFrame([("customer:1", "knows", "customer:2"), ("customer:1", "knows", "nobody")], "src string, predicate string, dst string").unionByName(e.where("predicate = 'lives_in'"))
    return store.add_edges(e, more, n)


@registered(f"WITH {BASE_SQL} SELECT DISTINCT node_id, CASE WHEN type = 'nation' THEN 'country' ELSE type END AS type FROM nodes")
def nodes_updated(spark, sf_dir):
    n = base_graph(spark, sf_dir)[0].select("node_id", "type").distinct()
    return store.update_where(n, F.col("type") == "nation", type="country")


@registered(f"WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges WHERE NOT (src = 'customer:1' AND predicate = 'lives_in')")
def edge_removed(spark, sf_dir):
    _, e, _ = base_graph(spark, sf_dir)
    e = e.select("src", "predicate", "dst").distinct()
    home = e.where("src = 'customer:1' and predicate = 'lives_in'").first()
    return store.remove_edge(e, *home) if home else e


@registered(f"""
WITH {BASE_SQL}, {DOCS_SQL} SELECT node_id, array_to_string(list_filter(CASE WHEN node_id = 'customer:2' THEN list_sort(list_distinct(list_append(documents, 'docZ'))) ELSE documents END, lambda d: d <> 'doc4'), ',') AS documents FROM g""")
def documents_linked(spark, sf_dir):
    """A document linked to a node, and another removed altogether."""
    n, e, d = base_graph(spark, sf_dir)
    linked = store.link_document(with_documents(n), "customer:2", "docZ")
    return joined(store.remove_document(linked, e, d, "doc4")[0])


@registered(f"WITH {BASE_SQL}, {DOCS_SQL} SELECT node_id, array_to_string(CASE WHEN node_id = 'nation:3' THEN [] ELSE documents END, ',') AS documents FROM g")
def document_unlinked(spark, sf_dir):
    return joined(store.unlink_document(with_documents(base_graph(spark, sf_dir)[0]), "nation:3", "doc3"))


@registered(f"""
WITH {BASE_SQL}, {DOCS_SQL}, t AS (SELECT 'doc0' AS document_id, 'customer:' || c_custkey AS src, 'topic:' || c_mktsegment AS dst FROM customer),
f AS (SELECT src AS node_id, document_id FROM t UNION SELECT dst, document_id FROM t UNION SELECT node_id, unnest(documents) FROM g)
SELECT node_id, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM f GROUP BY 1""")
def extraction_merged(spark, sf_dir):
    """What an extractor found about known and new nodes."""
    n, e, _ = base_graph(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    t = c.select(F.lit("doc0").alias("document_id"), F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.lit("about").alias("predicate"), F.concat(F.lit("topic:"), "c_mktsegment").alias("dst"))
    return joined(store.merge_extraction(with_documents(n), e.select("src", "predicate", "dst").distinct(), t)[0])


@registered(f"""
WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges UNION SELECT 'customer:' || c_custkey, 'about', 'topic:' || c_mktsegment FROM customer""")
def extraction_merged_edges(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    t = c.select(F.lit("doc0").alias("document_id"), F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.lit("about").alias("predicate"), F.concat(F.lit("topic:"), "c_mktsegment").alias("dst"))
    return store.merge_extraction(with_documents(n), e.select("src", "predicate", "dst").distinct(), t)[1]


# -- names, values and plans --------------------------------------------------------


@registered("SELECT c_custkey, 'cafe ' || lower(c_mktsegment) || ' file' AS folded FROM customer")
def folded_names(spark, sf_dir):
    """Marks off, compatibility forms resolved."""
    name = F.concat(F.lit("Café, "), F.translate("c_mktsegment", "AEIOU", "ÁÈÎÖÜ"), F.lit(" ﬁle"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.basic(name).alias("folded"))


@registered(f"""
WITH {MENTIONS_SQL} SELECT resolved_id, normalized_key, count(*) AS mention_count, count(DISTINCT document_id) AS doc_count, min(category) AS category FROM m GROUP BY ALL""")
def resolve_folded(spark, sf_dir):
    """Resolution of names with marks: the same keys as without them; the category of a block."""
    marked = mentions(spark, sf_dir).withColumn("name", F.translate("name", "AEIOUaeiou", "ÁÈÎÖÜáèîöü"))
    return resolve.resolved_entities(marked).select("resolved_id", "normalized_key", "mention_count", "doc_count", "category")


@registered("SELECT p_partkey, p_retailprice::DECIMAL(18,2)::DOUBLE AS price, NULL::DOUBLE AS none, p_name AS same FROM part")
def float_values(spark, sf_dir):
    """A number from text, none from other text, and an unknown transform."""
    p = table(spark, sf_dir, "part")
    price = F.concat(F.lit(" +"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("\t"))
    return p.select("p_partkey", F.nullif(N.to_float(price), F.lit("")).cast("double").alias("price"), F.nullif(N.to_float(F.concat(F.lit("$"), price)), F.lit("")).cast("double").alias("none"), N.transform("no_such")(F.col("p_name")).alias("same"))


@registered("SELECT doc_id, lang || ',tag' AS tags FROM documents")
def cleaned_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(texts.clean_list(F.array(F.concat(F.lit(" #"), "lang"), F.lit(" # "), F.lit(None).cast("string"), F.lit("tag "))), ",").alias("tags"))


@registered("""
SELECT n_nationkey, n_name || ' joined' || chr(10) || chr(10) || 'end' AS page FROM nation""")
def normalized_pages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    page = F.concat(F.lit("HEAD\n"), "n_name", F.lit(" join-\ned\n\n \n\nend\nFOOT"))
    return n.select("n_nationkey", texts.normalized_page(page, F.array(F.lit("HEAD")), F.array(F.lit("FOOT"))).alias("page"))


@registered("""
SELECT * FROM (VALUES ('keys', 'Customer', 'c_custkey'), ('keys', 'Nation', 'n_nationkey'), ('keys', 'Order', 'order_id'), ('link', 'Customer', 'Nation'), ('link', 'A', 'B'), ('main', 'Customer', 'c_custkey')) v(kind, name, value)""")
def ontology_normalised(spark, sf_dir):
    """Entities by name, relationships as text, a key by its attribute; the main entity by headers."""
    spec = {"entities": {"Customer": {"key": "c_custkey"}, "Nation": {"primary_key": ["n_nationkey"]}, "Order": {"attributes": [{"name": "order_id"}, {"name": "date"}]}},
            "relationships": [{"predicate": "lives_in", "source": "Customer", "target": {"name": "Nation"}}, "A -> B"]}
    o = ontology.normalise(spec)
    headers = ontology.Headers(table(spark, sf_dir, "customer").columns)
    rows = [("keys", e.name, ",".join(e.keys)) for e in o.entities] + [("link", r.source, r.target) for r in o.relationships] + [("main", *ontology.main_entity(o, headers))]
    return spark.createDataFrame(rows, "kind string, name string, value string")


@registered("""
SELECT 'Row' AS entity, 'key' AS what, 'c_custkey' AS name UNION ALL SELECT 'Row', 'attribute', unnest(['c_name', 'c_acctbal']) UNION ALL SELECT 'Row', 'has', unnest(['c_nationkey', 'c_mktsegment'])""")
def ontology_suggested(spark, sf_dir):
    """From a column profile of the whole table: key, attributes and relationships."""
    c = table(spark, sf_dir, "customer")
    spec = ontology.suggest([r.asDict() for r in profile.column_profile(c).collect()])  # one row a column
    main = spec["entities"][0]
    rows = [(main["name"], "key", main["key"])] + [(main["name"], "attribute", a["name"]) for a in main["attributes"]] + [(r["source"], "has", r["target"]) for r in spec["relationships"]]
    return spark.createDataFrame(rows, "entity string, what string, name string")


@registered("""
SELECT * FROM (VALUES ('entity ''Nation'': key ''n_nationkey'' is not among the headers'), ('relationship ''lives_in'': target_col ''n_nationkey'' is not among the headers')) v(issue)""")
def ontology_validated(spark, sf_dir):
    return spark.createDataFrame([(i,) for i in ontology.validate(ONTOLOGY, table(spark, sf_dir, "customer").columns)], "issue string")


@registered("SELECT 'customer:' || c_custkey AS node_id FROM customer UNION SELECT 'nation:' || c_nationkey FROM customer UNION SELECT 'other:' || c_custkey FROM customer")
def keys_populated(spark, sf_dir):
    """Entities without a key: by a join column, and by the first header."""
    spec = {"entities": [{"name": "Customer", "key": "c_custkey"}, {"name": "Nation"}, {"name": "Other"}],
            "relationships": [{"predicate": "in", "source": "Customer", "target": "Nation", "join_columns": {"source_col": "c_nationkey", "target_col": "n_nationkey"}}]}
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    mapping, _ = ontology.populate_keys(ontology.compile_all(spec, c.columns)[0], c.columns)
    return graph.nodes(c, mapping)


# -- streams ----------------------------------------------------------------------


def arriving(spark, df, parts: int, schema):
    """A stream over files that hold ``df``."""
    path = folder(spark, "arriving")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, parts // 2)).parquet(path)


def drained(stream, spark, sink, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()


@registered(f"""
WITH {MENTIONS_SQL} SELECT resolved_id, normalized_key, count(*) AS mention_count, count(DISTINCT document_id) AS doc_count FROM m GROUP BY ALL""")
def streamed_resolution(spark, sf_dir):
    """Mentions arrive in batches, some of them twice; the resolved entities of all."""
    inc = IncrementalResolver(spark, folder(spark, "state"))
    m = mentions(spark, sf_dir)
    drained(arriving(spark, m, 4, m.schema), spark, inc.sink())
    inc.add(mentions=m.where("entity_id like '%1'"), relations=relations(spark, sf_dir))
    return inc.tables(fold=False)["resolved_entities"].select("resolved_id", "normalized_key", "mention_count", "doc_count")


@registered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir):
    """Windowed counts of a stream with a watermark, as they stand at its end."""
    e, out = table(spark, sf_dir, "events").select("ts", "event_type"), VersionedTable(spark, folder(spark, "windows"))
    kind = e.schema["ts"].dataType
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))  # what watermarks take
    drained(event_counts(arriving(spark, e, 4, e.schema)), spark, lambda batch, _: out.write(batch), "complete")
    return out.read().withColumn("start", F.col("start").cast(kind))
