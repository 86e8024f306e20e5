"""The registered queries of the graph engine, each with DuckDB SQL of the same
result where SQL can express it. All results are flat.

The base graph: nation, customer and order nodes; placed, by, lives_in edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import names, texts
from weftline.functions import normalizers as N
from weftline.operators import analytics, catalog, chunk, extract, graph, profile, query, resolve, store
from weftline.plans import ontology
from weftline.plans.mapping import MappingSpec
from weftline.streaming.incremental import event_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- A. rows to graph -------------------------------------------------------------

ORDER_SPEC = MappingSpec.of({
    "entities": {
        "Customer": {"key": {"prefix": "customer:", "column": "o_custkey"}},
        "Order": {"key": {"prefix": "order:", "column": "o_orderkey"}},
        "Priority": {"key": {"prefix": "priority:", "column": "o_orderpriority", "transform": "slug"}},
    },
    "edges": [
        {"predicate": "placed", "source": {"entity": "Customer"}, "target": {"entity": "Order"}},
        {"label": "has_priority", "source": {"entity": "Order"}, "target": {"entity": "Priority"}},
        {"source": {"entity": "Order"}, "target": {"entity": "Customer"}},
    ],
})

SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@registered(f"""
SELECT DISTINCT unnest(['customer:' || o_custkey, 'order:' || o_orderkey, 'priority:' || {SLUG.format('o_orderpriority')}]) AS node_id FROM orders""")
def kg_nodes(spark, sf_dir):
    """Ids by prefix and transform, distinct."""
    return graph.nodes(table(spark, sf_dir, "orders"), ORDER_SPEC)


@registered(f"""
SELECT DISTINCT 'customer:' || o_custkey AS src, 'placed' AS predicate, 'order:' || o_orderkey AS dst FROM orders
UNION SELECT 'order:' || o_orderkey, 'has_priority', 'priority:' || {SLUG.format('o_orderpriority')} FROM orders""")
def kg_edges(spark, sf_dir):
    """Edges; the one without a predicate is left out."""
    return graph.edges(table(spark, sf_dir, "orders"), ORDER_SPEC)


@registered("""
SELECT DISTINCT 'line:' || l_orderkey || '|' || l_linenumber || '|' AS node_id FROM lineitem
UNION SELECT 'part:' || l_partkey FROM lineitem""")
def kg_template_nodes(spark, sf_dir):
    """A composite key by template; an unknown column is empty."""
    spec = MappingSpec.of({"entities": {"Line": {"key": {"template": "line:{l_orderkey}|{l_linenumber}|{no_such}"}}, "Part": {"key": {"prefix": "part:", "column": "l_partkey"}}}})
    return graph.nodes(table(spark, sf_dir, "lineitem"), spec)


@registered("""
SELECT DISTINCT 'order:' || o_orderkey AS src, 'open' AS predicate, 'open:' || o_orderkey AS dst FROM orders WHERE o_orderstatus = 'O'""")
def kg_null_policy(spark, sf_dir):
    """An end that is empty leaves the edge out, with either policy."""
    df = table(spark, sf_dir, "orders").withColumn("open", F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")))
    spec = MappingSpec.of({
        "entities": {"Order": {"key": {"prefix": "order:", "column": "o_orderkey"}}, "Open": {"key": {"prefix": "open:", "column": "open"}}},
        "edges": [{"predicate": "open", "source": {"entity": "Order"}, "target": {"entity": "Open"}}], "options": {"null_policy": "keep"}})
    return graph.edges(df, spec)


@registered(f"""
SELECT DISTINCT 'segment:' || {SLUG.format('c_mktsegment')} AS node_id FROM customer
UNION SELECT 'customer:' || {SLUG.format('c_name')} FROM customer""")
def kg_slug_dimension(spark, sf_dir):
    """The star compiler: dimensions keyed by slugs of the headers that name them."""
    spec, _ = ontology.compile_star({"entities": [{"name": "Customer", "key": "c_name"}], "relationships": [{"predicate": "in", "source": "Customer", "target": "Segment"}]}, ["c_name", "c_mktsegment"])
    spec.entities["Customer"].key = type(spec.entities["Customer"].key)("c_name", "customer:", "slug")
    return graph.nodes(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), spec)


ONTOLOGY = {
    "entities": [
        {"name": "Customer", "primary_key": ["c_custkey"], "attributes": [{"name": "c_name", "type": "string", "description": "customer name"}, {"name": "c_acctbal", "type": "float"}]},
        {"name": "Nation", "primary_key": ["n_nationkey"], "attributes": [{"name": "n_name"}]},
    ],
    "relationships": [{"predicate": "lives_in", "source": "Customer", "target": "Nation", "join_columns": {"source_col": "c_nationkey", "target_col": "n_nationkey"}}],
}


def customers(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), "n_nationkey", "n_name")


def compiled(headers):
    return ontology.compile_mapping(ONTOLOGY, headers)[0]


@registered("""
SELECT DISTINCT 'customer:' || c_custkey AS src, 'lives_in' AS predicate, 'nation:' || c_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def kg_compiled_edges(spark, sf_dir):
    """The full compiler: an edge by the join column under the target's prefix."""
    df = customers(spark, sf_dir)
    return graph.edges(df, compiled(df.columns))


@registered("""
SELECT 'customer:' || c_custkey AS node_id, 'customer' AS type, c_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT DISTINCT 'nation:' || n_nationkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def kg_labelled_nodes(spark, sf_dir):
    """Types and labels: the first non-blank value by the order of rows."""
    df = customers(spark, sf_dir)
    return graph.labelled_nodes(df, compiled(df.columns), "c_custkey").select("node_id", "type", "label")


@registered("""
WITH r AS (
  SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer)
SELECT 'nation:' || c_nationkey AS node_id, 'segment' AS attribute, arg_min(seg, c_custkey) FILTER (WHERE seg <> '') AS value
FROM r GROUP BY c_nationkey HAVING count(*) FILTER (WHERE seg <> '') > 0""")
def kg_first_non_empty(spark, sf_dir):
    """Rows with the same id are merged: later rows fill only what is empty."""
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    spec = MappingSpec.of({"entities": {"Nation": {"key": {"prefix": "nation:", "column": "c_nationkey"}, "attributes": [{"name": "segment", "column": "seg"}]}}})
    return graph.properties_long(graph.labelled_nodes(df, spec, "c_custkey"))


@registered("""
SELECT 'customer:' || c_custkey AS node_id, unnest(['c_name', 'c_acctbal']) AS attribute, unnest([c_name, c_acctbal::DECIMAL(18,2)::VARCHAR]) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'nation:' || n_nationkey, 'n_name', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def kg_properties(spark, sf_dir):
    df = customers(spark, sf_dir)
    return graph.properties_long(graph.labelled_nodes(df, compiled(df.columns), "c_custkey"))


# -- C, D. profile and normalizers --------------------------------------------------


@registered(f"""
SELECT p_partkey, trim('  ' || p_name || '  ') AS trimmed, lower(p_name) AS lowered, upper(p_brand) AS uppered, {SLUG.format('p_type')} AS slugged,
  lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS snaked, trunc(p_retailprice)::BIGINT::VARCHAR AS whole,
  CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE '' END AS truth FROM part""")
def normalizers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = F.when(F.col("p_size") % 3 == 0, " Yes ").when(F.col("p_size") % 3 == 1, "F").otherwise("maybe")
    price = F.col("p_retailprice").cast("decimal(18,4)")
    return p.select(
        "p_partkey", N.trim(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))).alias("trimmed"), N.lower(F.col("p_name")).alias("lowered"), N.upper(F.col("p_brand")).alias("uppered"),
        N.slug(F.col("p_type")).alias("slugged"), N.snake(F.col("p_brand")).alias("snaked"), N.to_int(price).alias("whole"), N.to_bool(word).alias("truth"))


@registered("""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.title_case(F.col("p_type")).alias("title"))


def order_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.col("o_orderpriority"), F.lit("1.5").alias("weight"), F.lit("yes").alias("flag"), F.col("o_orderkey").alias("ord"))


CELLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "weight", "flag"]
CELLS_SQL = """
c AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE o_orderstatus END AS o_orderstatus,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, '1.5' AS weight, 'yes' AS flag FROM orders),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE value)"""


@registered(f"""
WITH {CELLS_SQL}
SELECT name, count(*) FILTER (WHERE trim(value) <> '') AS non_null, count(*) FILTER (WHERE trim(value) = '') AS nulls,
  count(DISTINCT value) FILTER (WHERE trim(value) <> '') AS distinct FROM u GROUP BY name""")
def csv_profile(spark, sf_dir):
    return profile.column_profile(order_cells(spark, sf_dir), CELLS, "ord").select("name", "non_null", "nulls", "distinct")


@registered(f"""
WITH {CELLS_SQL}
SELECT name, CASE WHEN bool_and(regexp_matches(trim(value), '^[+-]?[0-9]+$')) THEN 'integer' WHEN bool_and(regexp_matches(trim(value), '^[+-]?[0-9]+(\\.[0-9]+)?$')) THEN 'float'
  WHEN bool_and(lower(trim(value)) IN ('true','false','t','f','yes','no','0','1')) THEN 'bool' WHEN bool_and(regexp_matches(trim(value), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) THEN 'date' ELSE 'string' END AS inferred_type
FROM u WHERE trim(value) <> '' GROUP BY name""")
def type_inference(spark, sf_dir):
    return profile.column_profile(order_cells(spark, sf_dir), CELLS, "ord").select("name", "inferred_type")


@registered("""
SELECT 'o_orderstatus' AS name, string_agg(s, ',' ORDER BY k) AS examples FROM (
  SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1 ORDER BY k LIMIT 3)""")
def profile_examples(spark, sf_dir):
    """The first three different values of a column, in the order of rows."""
    p = profile.column_profile(order_cells(spark, sf_dir), ["o_orderstatus"], "ord")
    return p.select("name", F.array_join("examples", ",").alias("examples"))


@registered("""
SELECT substr(sha1('r_regionkey|r_name,' || string_agg(r_regionkey || '|' || r_name, '' ORDER BY r_regionkey)), 1, 16) AS fingerprint FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 20)""")
def dataset_fingerprint(spark, sf_dir):
    return profile.dataset_fingerprint(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])


@registered("SELECT 'r_regionkey=' || r_regionkey || ', r_name=' || r_name AS line FROM region")
def csv_preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "region"))


# -- E. resolution -------------------------------------------------------------------

VARIANTS_SQL = """
v AS (SELECT p_partkey AS row_no, CASE p_partkey % 4 WHEN 0 THEN 'type:' || upper(p_type) WHEN 1 THEN 'type: ' || p_type WHEN 2 THEN 'kind:' || replace(p_type, ' ', '-') ELSE 'txn:' || p_type END AS node_id FROM part),
n AS (SELECT node_id, min(row_no) AS row_no FROM v GROUP BY node_id),
e AS (SELECT DISTINCT node_id AS src, 'like' AS predicate, 'brand:' || p_brand AS dst FROM v JOIN part ON p_partkey = row_no)"""


def variants(spark, sf_dir):
    """Part types under ids that differ in case, blanks, signs and prefix."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    node_id = (
        F.when(k == 0, F.concat(F.lit("type:"), F.upper("p_type"))).when(k == 1, F.concat(F.lit("type: "), "p_type"))
        .when(k == 2, F.concat(F.lit("kind:"), F.replace("p_type", F.lit(" "), F.lit("-")))).otherwise(F.concat(F.lit("txn:"), "p_type")))
    v = p.select(F.col("p_partkey").alias("row_no"), node_id.alias("node_id"), "p_brand")
    nodes = v.groupBy("node_id").agg(F.min("row_no").alias("row_no"))
    return nodes, v.select(F.col("node_id").alias("src"), F.lit("like").alias("predicate"), F.concat(F.lit("brand:"), "p_brand").alias("dst")).distinct()


CANON = "CASE WHEN split_part({0}, ':', 1) = 'txn' THEN {0} ELSE split_part({0}, ':', 1) || ':' || " + SLUG.format("substr({0}, instr({0}, ':') + 1)") + " END"


@registered(f"WITH {VARIANTS_SQL} SELECT DISTINCT {CANON.format('src')} AS src, predicate, {CANON.format('dst')} AS dst FROM e")
def resolve_canonical(spark, sf_dir):
    return resolve.resolve_entities(*variants(spark, sf_dir))[1]


@registered(f"""
WITH {VARIANTS_SQL}
SELECT split_part(node_id, ':', 1) AS prefix, count(DISTINCT node_id) - count(DISTINCT {CANON.format('node_id')}) AS merged FROM n GROUP BY 1""")
def merge_statistics(spark, sf_dir):
    return resolve.merge_statistics(resolve.resolve_entities(*variants(spark, sf_dir))[2])


@registered(f"""
WITH {VARIANTS_SQL},
k AS (SELECT node_id, row_no, regexp_replace(lower(substr(node_id, instr(node_id, ':') + 1)), '[^a-z0-9]+', '', 'g') AS k FROM n),
f AS (SELECT k, arg_min(node_id, row_no) AS first FROM k GROUP BY k)
SELECT node_id AS old_id, first AS new_id FROM k JOIN f USING (k)""")
def resolve_simple(spark, sf_dir):
    """One id for equal labels, whatever the prefix; the first seen."""
    return resolve.resolve_simple(*variants(spark, sf_dir), order="row_no")[2]


@registered(f"""
WITH {VARIANTS_SQL},
k AS (SELECT node_id, row_no, regexp_replace(lower(substr(node_id, instr(node_id, ':') + 1)), '[^a-z0-9]+', '', 'g') AS k FROM n),
f AS (SELECT k, arg_min(node_id, row_no) AS first FROM k GROUP BY k),
m AS (SELECT node_id AS old_id, first AS new_id FROM k JOIN f USING (k)),
r AS (SELECT DISTINCT coalesce(a.new_id, src) AS src, coalesce(b.new_id, dst) AS dst FROM e LEFT JOIN m a ON src = a.old_id LEFT JOIN m b ON dst = b.old_id)
SELECT DISTINCT new_id AS node_id FROM m WHERE new_id IN (SELECT src FROM r UNION SELECT dst FROM r)""")
def resolve_simple_pruned(spark, sf_dir):
    """The same with nodes without an edge left out."""
    return resolve.resolve_simple(*variants(spark, sf_dir), order="row_no", prune=True)[0]


MENTIONS_SQL = """
mentions AS (
  SELECT 'c' || c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'Dr. ' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 'Person' ELSE 'Company' END AS type, 'named' AS category, 'd' || (c_nationkey % 5) AS document_id,
    TIMESTAMP '2020-01-01' + to_days((c_custkey % 365)::INTEGER) AS created_at FROM customer),
b AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS b FROM mentions),
keyed AS (
  SELECT *, lower(type) || '|' || trim(CASE WHEN type = 'Person' THEN regexp_replace(b, '\\b(dr|prof|mr|mrs|ms)\\b\\s*', '', 'g') ELSE regexp_replace(b, '\\b(inc|ltd|corp|llc|co)\\b', '', 'g') END) AS normalized_key FROM b),
m AS (SELECT *, 'res::' || substr(sha1(normalized_key), 1, 16) AS resolved_id FROM keyed)"""


def mentions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Dr. "), "c_mktsegment")).when(k == 1, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return c.select(
        F.concat(F.lit("c"), "c_custkey").alias("entity_id"), name.alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Person").otherwise("Company").alias("type"), F.lit("named").alias("category"),
        F.concat(F.lit("d"), F.col("c_nationkey") % 5).alias("document_id"), F.lit(0).alias("chunk_id"),
        F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, cast(c_custkey % 365 as int))").alias("created_at"))


def relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("r"), "o_orderkey").alias("relationship_id"), F.concat(F.lit("c"), "o_custkey").alias("source_entity_id"), F.concat(F.lit("c"), F.col("o_orderkey") % 2000).alias("target_entity_id"),
        F.lower("o_orderstatus").alias("relation"), F.concat(F.lit("d"), F.col("o_orderkey") % 5).alias("document_id"), F.lit(0).alias("chunk_id"), F.col("o_orderdate").alias("created_at"))


RELATIONS_SQL = """
relations AS (
  SELECT 'r' || o_orderkey AS relationship_id, 'c' || o_custkey AS s, 'c' || (o_orderkey % 2000) AS t, lower(o_orderstatus) AS relation, 'd' || (o_orderkey % 5) AS document_id, o_orderdate AS created_at FROM orders),
p AS (SELECT r.*, a.resolved_id AS sr, b.resolved_id AS tr, substr(sha1(a.resolved_id || '|' || relation || '|' || b.resolved_id), 1, 16) AS rid
  FROM relations r JOIN m a ON r.s = a.entity_id JOIN m b ON r.t = b.entity_id)"""


@registered(f"""
WITH {MENTIONS_SQL},
n AS (SELECT resolved_id, name, count(*) AS c FROM m GROUP BY ALL),
f AS (SELECT resolved_id, name FROM n QUALIFY row_number() OVER (PARTITION BY resolved_id ORDER BY c DESC, length(name) DESC, name) = 1)
SELECT m.resolved_id, f.name, m.normalized_key, count(*) AS mention_count, count(DISTINCT document_id) AS doc_count FROM m JOIN f USING (resolved_id) GROUP BY ALL""")
def resolve_blocked(spark, sf_dir):
    return resolve.resolved_entities(mentions(spark, sf_dir), fold=False).select("resolved_id", "name", "normalized_key", "mention_count", "doc_count")


@registered(f"""
WITH {MENTIONS_SQL}, {RELATIONS_SQL}
SELECT rid AS resolved_relationship_id, sr AS source_resolved_id, relation, tr AS target_resolved_id, count(*) AS weight, count(DISTINCT document_id) AS doc_count,
  min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM p GROUP BY ALL""")
def resolved_edges(spark, sf_dir):
    return resolve.resolve(mentions(spark, sf_dir), relations(spark, sf_dir), fold=False)["resolved_relationships"]


@registered(f"""
WITH {MENTIONS_SQL}, {RELATIONS_SQL},
x AS (SELECT DISTINCT sr, tr FROM p WHERE rid IN (SELECT rid FROM p WHERE document_id = 'd1')),
d AS (SELECT resolved_id, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents FROM m GROUP BY 1)
SELECT d.resolved_id, d.documents FROM d WHERE d.resolved_id IN (SELECT sr FROM x UNION SELECT tr FROM x)""")
def resolved_snapshot_filtered(spark, sf_dir):
    m = mentions(spark, sf_dir)
    nodes, _ = resolve.resolved_snapshot(resolve.resolve(m, relations(spark, sf_dir), fold=False), m, ["d1"])
    return nodes.select("resolved_id", F.array_join("documents", ",").alias("documents"))


@registered(f"""
WITH {MENTIONS_SQL}, {RELATIONS_SQL}
SELECT (SELECT count(*) FROM mentions) AS mentions, (SELECT count(DISTINCT resolved_id) FROM m) AS entities, (SELECT count(DISTINCT rid) FROM p) AS relationships, (SELECT count(*) FROM p) AS provenance""")
def resolution_statistics(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return resolve.run_statistics(m, resolve.resolve(m, relations(spark, sf_dir), fold=False))


@registered("""
SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower('12 St. ' || s_name || ' Ave'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))
  .regexp_replace('\\bst\\b', 'street', 'g').regexp_replace('\\bave\\b', 'avenue', 'g') AS place FROM supplier""")
def normalize_location(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", names.normalize_name(F.concat(F.lit("12 St. "), "s_name", F.lit(" Ave")), F.lit("City")).alias("place"))


# -- G. store ------------------------------------------------------------------------


def base_graph(spark, sf_dir):
    """(nodes, edges, documents): nations, customers and orders; a nation's customers
    and their orders are in its document."""
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    doc = F.concat(F.lit("doc"), F.col("c_nationkey"))
    co = o.join(c, o.o_custkey == c.c_custkey)
    kb = (F.col("c_nationkey") % 2).cast("long")
    nodes = (
        n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node_id"), F.lit("nation").alias("type"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 2).cast("long").alias("kb_id"), F.concat(F.lit("doc"), "n_nationkey").alias("document_id"))
        .unionByName(c.select(F.concat(F.lit("customer:"), "c_custkey").alias("node_id"), F.lit("customer").alias("type"), F.col("c_name").alias("label"), kb.alias("kb_id"), doc.alias("document_id")))
        .unionByName(co.select(F.concat(F.lit("order:"), "o_orderkey").alias("node_id"), F.lit("order").alias("type"), F.col("o_orderpriority").alias("label"), kb.alias("kb_id"), doc.alias("document_id"))))
    edges = (
        c.select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.lit("lives_in").alias("predicate"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"), kb.alias("kb_id"), doc.alias("document_id"))
        .unionByName(co.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.lit("placed").alias("predicate"), F.concat(F.lit("order:"), "o_orderkey").alias("dst"), kb.alias("kb_id"), doc.alias("document_id"))))
    docs = n.select(F.concat(F.lit("doc"), "n_nationkey").alias("document_id"), (F.col("n_nationkey") % 2).cast("long").alias("kb_id"), F.concat(F.lit("Report on "), "n_name").alias("title"))
    return nodes, edges, docs


BASE_SQL = """
nodes AS (
  SELECT 'nation:' || n_nationkey AS node_id, 'nation' AS type, n_name AS label, n_nationkey % 2 AS kb_id, 'doc' || n_nationkey AS document_id FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_nationkey % 2, 'doc' || c_nationkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, c_nationkey % 2, 'doc' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS (
  SELECT 'customer:' || c_custkey AS src, 'lives_in' AS predicate, 'nation:' || c_nationkey AS dst, c_nationkey % 2 AS kb_id, 'doc' || c_nationkey AS document_id FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey, c_nationkey % 2, 'doc' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
docs AS (SELECT 'doc' || n_nationkey AS document_id, n_nationkey % 2 AS kb_id, 'Report on ' || n_name AS title FROM nation)"""


@registered(f"""
WITH {BASE_SQL}
SELECT DISTINCT 'node' AS kind, node_id AS a, type AS b, label AS c FROM nodes WHERE kb_id = 1 AND document_id = 'doc3'
UNION ALL SELECT DISTINCT 'edge', src, predicate, dst FROM edges WHERE kb_id = 1 AND document_id = 'doc3'
UNION ALL SELECT 'document', document_id, title, NULL FROM docs WHERE kb_id = 1 AND document_id = 'doc3'""")
def graph_snapshot(spark, sf_dir):
    n, e, d = store.snapshot(*base_graph(spark, sf_dir), kb_id=1, document_id="doc3")
    out = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("type").alias("b"), F.col("label").alias("c"))
    out = out.unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("predicate").alias("b"), F.col("dst").alias("c")))
    return out.unionByName(d.select(F.lit("document").alias("kind"), F.col("document_id").alias("a"), F.col("title").alias("b"), F.lit(None).cast("string").alias("c")))


def with_documents(nodes):
    return nodes.groupBy("node_id", "type", "label").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))


@registered(f"""
WITH {BASE_SQL}, l AS (SELECT node_id, any_value(label) AS label, min(document_id) AS d FROM nodes WHERE node_id NOT LIKE 'order:%7' GROUP BY 1)
SELECT coalesce(a.label, src) AS source, predicate, coalesce(b.label, dst) AS target, coalesce(x.title, y.title, '—') AS document
FROM (SELECT src, predicate, dst, CASE WHEN predicate = 'placed' THEN NULL ELSE document_id END AS document_id FROM edges) e
LEFT JOIN l a ON src = a.node_id LEFT JOIN l b ON dst = b.node_id LEFT JOIN docs x ON x.document_id = e.document_id LEFT JOIN docs y ON y.document_id = a.d""")
def edge_table(spark, sf_dir):
    """Labels and titles for ids, with their fallbacks."""
    n, e, d = base_graph(spark, sf_dir)
    nodes = with_documents(n.where("node_id not like 'order:%7'"))
    e = e.withColumn("document_id", F.when(F.col("predicate") != "placed", F.col("document_id")))
    return store.edge_table(e, nodes, d)


@registered(f"""
WITH {BASE_SQL}
SELECT DISTINCT CASE WHEN src = 'customer:2' THEN 'customer:1' ELSE src END AS src, predicate, CASE WHEN dst = 'customer:2' THEN 'customer:1' ELSE dst END AS dst FROM edges""")
def merge_nodes(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return store.merge_nodes(with_documents(n), e.select("src", "predicate", "dst"), "customer:1", "customer:2")[1]


@registered(f"""
WITH {BASE_SQL}
SELECT label AS name, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents FROM nodes WHERE contains(lower(label), 'tion_1') GROUP BY 1 ORDER BY 1 LIMIT 10""")
def search_entities(spark, sf_dir):
    out = store.search_entities(base_graph(spark, sf_dir)[0], "Tion_1")
    return out.select("name", F.array_join("documents", ",").alias("documents"))


@registered(f"""
WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges WHERE contains(lower(src), ':12') OR contains(lower(predicate), ':12') OR contains(lower(dst), ':12') ORDER BY 1, 2, 3 LIMIT 10""")
def search_relationships(spark, sf_dir):
    return store.search_relationships(base_graph(spark, sf_dir)[1], ":12")


@registered(f"""
WITH RECURSIVE {BASE_SQL},
x AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
w(node_id, d) AS (SELECT 'nation:3', 0 UNION SELECT b, d + 1 FROM w JOIN x ON a = node_id WHERE d < 2)
SELECT node_id AS entity, min(d)::INTEGER AS distance FROM w GROUP BY 1 HAVING min(d) > 0""")
def entity_connections(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return store.entity_connections(n, e, "nation:3", 2)


@registered(f"WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges WHERE document_id <> 'doc3'")
def delete_document(spark, sf_dir):
    n, e, d = base_graph(spark, sf_dir)
    return store.delete_document({"nodes": n, "edges": e, "documents": d}, "doc3")["edges"].select("src", "predicate", "dst").distinct()


@registered(f"""
WITH {BASE_SQL} SELECT (SELECT count(DISTINCT node_id) FROM nodes) AS entities, (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT (src, predicate, dst)) FROM edges) AS relationships""")
def graph_statistics(spark, sf_dir):
    return store.statistics(*base_graph(spark, sf_dir))


@registered("""
SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    """Old and new rows by key: the new ones win, the latest of them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    old = e.groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("at", F.lit(None).cast(e.schema["at"].dataType))
    return store.upsert(old, e, ["user_id"], "at").select("user_id", "event_id")


@registered("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND contains(lower(o_orderpriority), 'ur') AND o_totalprice > 1000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5""")
def query_options(spark, sf_dir):
    o = query.Options([query.Filter("o_orderstatus", "in", ["O", "F"]), query.Filter("o_orderpriority", "like", "UR"), query.Filter("o_totalprice", "gt", 1000)], "o_totalprice", True, 5, 25)
    return query.query(table(spark, sf_dir, "orders"), o, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@registered("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice <= 50000")
def query_count(spark, sf_dir):
    return query.count(table(spark, sf_dir, "orders"), query.Options([query.Filter("o_orderstatus", "ne", "O"), query.Filter("o_totalprice", "lte", 50000)]))


@registered("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@registered("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events"))


# -- H. analytics ----------------------------------------------------------------------


@registered(f"""
WITH {BASE_SQL}, x AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT node_id, count(*) AS c FROM x GROUP BY 1)
SELECT n.node_id, coalesce(c, 0) AS degree FROM (SELECT DISTINCT node_id FROM nodes) n LEFT JOIN g USING (node_id)""")
def graph_degree(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.degree(n, e)


@registered(f"WITH {BASE_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM docs) AS documents")
def graph_totals(spark, sf_dir):
    return analytics.totals(*base_graph(spark, sf_dir))


@registered(f"""
WITH {BASE_SQL}, t AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges)
SELECT nodes, edges, edges::DOUBLE / (nodes::DOUBLE * (nodes - 1)::DOUBLE) AS density, 2 * edges::DOUBLE / nodes::DOUBLE AS average_degree FROM t""")
def graph_density(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.density(n, e)


@registered(f"""
WITH {BASE_SQL} SELECT node_id FROM nodes WHERE type = 'customer' AND node_id NOT IN (SELECT src FROM edges WHERE dst LIKE 'order:%00')""")
def graph_isolates(spark, sf_dir):
    """Customers without an order whose key ends in 00."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.isolates(n.where("type = 'customer'"), e.where("dst like 'order:%00'")).select("node_id")


@registered(f"""
WITH {BASE_SQL}, x AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges)
SELECT node_id, count(*) AS degree FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_degree(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.top_degree(n, e)


@registered(f"""
WITH {BASE_SQL}, l AS (SELECT DISTINCT node_id FROM nodes WHERE document_id IN ('doc1', 'doc2'))
SELECT DISTINCT src, predicate, dst FROM edges WHERE document_id IN ('doc1', 'doc2') OR src IN (FROM l) OR dst IN (FROM l)""")
def visible_subgraph(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.visible_subgraph(with_documents(n), e, ["doc1", "doc2"])[1].select("src", "predicate", "dst").distinct()


BASE_PAIRS = "x AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


@registered(f"WITH {BASE_SQL} SELECT DISTINCT node_id, min(node_id) OVER (PARTITION BY document_id) AS component FROM nodes")
def components(spark, sf_dir):
    """Components of the base graph: a nation, its customers and their orders each."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.components(n.select("node_id").distinct(), e)


@registered(f"""
WITH RECURSIVE {BASE_SQL}, {BASE_PAIRS},
w(s, node_id, d) AS (SELECT node_id, node_id, 0 FROM nodes WHERE type = 'nation' UNION SELECT s, b, d + 1 FROM w JOIN x ON a = node_id WHERE d < 4),
m AS (SELECT s, node_id, min(d) AS d FROM w GROUP BY ALL)
SELECT s AS node_id, coalesce(round(count(*) FILTER (WHERE d > 0)::DOUBLE / nullif(sum(d), 0)::DOUBLE, 9), 0) AS closeness FROM m GROUP BY 1""")
def closeness(spark, sf_dir):
    """Of all nations, in the whole base graph."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.closeness(n, e, n.where("type = 'nation'")).withColumn("closeness", F.round("closeness", 9))


def _pagerank_sql(rounds: int) -> str:
    steps = ["ids AS MATERIALIZED (SELECT DISTINCT node_id FROM nodes)", "e AS MATERIALIZED (SELECT src, dst FROM edges)", "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM ids)", "o AS MATERIALIZED (SELECT src, count(*) AS c FROM e GROUP BY src)", "p0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / n AS p FROM ids, n)"]
    for i in range(rounds):
        steps.append(f"""p{i + 1} AS MATERIALIZED (
  SELECT ids.node_id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * s.s / n.n + 0.85::DOUBLE * coalesce(g.s, 0) AS p
  FROM ids CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(p), 0) AS s FROM p{i} WHERE node_id NOT IN (SELECT src FROM o)) s
  LEFT JOIN (SELECT e.dst, sum(q.p / o.c) AS s FROM e JOIN p{i} q ON q.node_id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = ids.node_id)""")
    return f"WITH {BASE_SQL}, {', '.join(steps)} SELECT node_id, round(p, 9) AS pagerank FROM p{rounds}"


@registered(_pagerank_sql(16))
def pagerank(spark, sf_dir):
    """Over the whole base graph until it stands still; so far SQL writes its rounds out."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.pagerank(n, e, eps=1e-12).withColumn("pagerank", F.round("pagerank", 9))


def _label_propagation_sql(rounds: int) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT node_id, node_id AS c FROM nodes)", "y AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst)"]
    for i in range(rounds):
        steps.append(f"""l{i + 1} AS MATERIALIZED (
  SELECT node_id, c FROM (SELECT node_id, c, count(*) AS w FROM (SELECT a AS node_id, c FROM y JOIN l{i} ON b = node_id UNION ALL SELECT node_id, c FROM l{i}) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY w DESC, c) = 1)""")
    return f"WITH {BASE_SQL}, {', '.join(steps)} SELECT node_id, c AS community FROM l{rounds}"


@registered(_label_propagation_sql(20))
def label_propagation(spark, sf_dir):
    """Communities of the whole base graph after 20 rounds at most."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.label_propagation(n, e)


# -- F. text -------------------------------------------------------------------------------


@registered("""
SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 100 THEN 'skip' WHEN length(text) // 4 >= 1000 THEN 'chunk' ELSE 'document' END AS route FROM documents""")
def doc_tokens_route(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", texts.token_estimate(t).alias("tokens"), texts.route(t, limit=1000).alias("route"))


@registered("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Personal knowledge document' ELSE 'Document: ' || source || CASE WHEN doc_id % 2 = 0 THEN ' | Type: md' ELSE '' END || ' | Tags: ' || lang || ', x, y' END AS context FROM documents""")
def doc_context(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.when(k % 5 != 0, F.col("source"))
    kind = F.when((k % 5 != 0) & (k % 2 == 0), F.lit("md"))
    tags = F.when(k % 5 != 0, F.array("lang", F.lit("x"), F.lit("y"), F.lit("z")))
    return d.select("doc_id", texts.extraction_context(title, kind, tags).alias("context"))


MARKED_SQL = """
d AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || '![[pic.png]] **bold** and *it* `code` [[Link ' || doc_id || ']] %%note' || chr(10) || 'more%%' || chr(10) || chr(10) || chr(10) || chr(10) || regexp_replace(text, '[*`#%\\[\\]]', '', 'g') || chr(10) || '## Part' || chr(10) || '[[' || lang || ']]' AS t FROM documents)"""


def marked(spark, sf_dir):
    """Each whole document with markup about it: fixtures for the cleaning passes."""
    d = table(spark, sf_dir, "documents")
    body = F.regexp_replace("text", r"[*`#%\[\]]", "")
    t = F.concat(F.lit("# Title "), "doc_id", F.lit("\n![[pic.png]] **bold** and *it* `code` [[Link "), "doc_id", F.lit("]] %%note\nmore%%\n\n\n\n"), body, F.lit("\n## Part\n[["), "lang", F.lit("]]"))
    return d.select("doc_id", t.alias("text"))


@registered(f"""
WITH {MARKED_SQL},
a AS (SELECT doc_id, regexp_replace(t, '!\\[\\[(.*?)\\]\\]', '', 'g') AS t FROM d), b AS (SELECT doc_id, regexp_replace(t, '\\[\\[(.*?)\\]\\]', '\\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '%%.*?%%', '', 'gs') AS t FROM b), e AS (SELECT doc_id, regexp_replace(t, '\\*\\*(.*?)\\*\\*', '\\1', 'g') AS t FROM c),
f AS (SELECT doc_id, regexp_replace(t, '\\*(.*?)\\*', '\\1', 'g') AS t FROM e), g AS (SELECT doc_id, regexp_replace(t, '`([^`]+)`', '\\1', 'g') AS t FROM f),
h AS (SELECT doc_id, regexp_replace(t, '#{{1,6}}\\s+', '', 'g') AS t FROM g), i AS (SELECT doc_id, regexp_replace(t, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g') AS t FROM h)
SELECT doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM i""")
def clean_markdown(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", texts.clean_markdown(F.col("text")).alias("text"))


@registered(f"""
WITH {MARKED_SQL} SELECT doc_id, unnest(['Link ' || doc_id, regexp_extract(t, '\\[\\[([a-z]*)\\]\\]$', 1)]) AS link FROM d""")
def wiki_links(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.explode(texts.wiki_links(F.col("text"))).alias("link"))


@registered("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))::INTEGER AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.word_count(F.col("text")).alias("words"))


@registered(f"WITH {MARKED_SQL} SELECT doc_id, unnest(['Title ' || doc_id, 'Part']) AS header FROM d")
def section_headers(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.explode(texts.section_headers(F.col("text"))).alias("header"))


@registered()
def chunk_stats(spark, sf_dir):
    """Chunks of all documents; tested by invariants."""
    c = chunk.chunk_documents(table(spark, sf_dir, "documents"), id_col="doc_id")
    return chunk.chunk_statistics(c)


@registered("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)
SELECT doc_id || '_chunk_' || idx AS chunk_id, lag(doc_id || '_chunk_' || idx) OVER w AS prev_id, lead(doc_id || '_chunk_' || idx) OVER w AS next_id FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def chunk_neighbours(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "content"))
    return chunk.with_neighbours(lines).select("chunk_id", "prev_id", "next_id")


@registered("""
SELECT doc_id AS document_id, 'HEAD ' || lang AS headers, 'FOOT' AS footers FROM documents""")
def page_headers_footers(spark, sf_dir):
    """Three pages a document with a running header and footer, found again."""
    d = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("HEAD "), "lang", F.lit("\n"), F.lit("p"), F.lit("{}"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit("\nFOOT"))
    pages = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.replace(page, F.lit("{}"), i.cast("string"))), "\f")
    r = chunk.running_lines(d.select(F.col("doc_id").alias("document_id"), pages.alias("text")))
    return r.select("document_id", F.array_join("headers", ",").alias("headers"), F.array_join("footers", ",").alias("footers"))


@registered()
def page_chunks(spark, sf_dir):
    """Every ten lines of a document as a page; tested by invariants."""
    lines = F.split("text", "\n", -1)
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10)), lambda i: F.array_join(F.slice(lines, (i * 10 + 1).cast("int"), 10), "\n"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(pages, "\f").alias("text"))
    return chunk.chunk_pages(d).select("chunk_id", "document_id", "page_number", "start", "end", "word_count", "strategy", "prev_id", "next_id")


@registered()
def extract_triples(spark, sf_dir):
    """The default extractor's relations over all documents."""
    return extract.extracted_graph(extract.extract(table(spark, sf_dir, "documents"), id_cols=("doc_id",)))[1]


# -- catalogue and the rest of the inventory ------------------------------------------------


@registered("""
SELECT c_nationkey AS owner, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM customer GROUP BY ALL""")
def knowledge_base_slugs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("owner"), names.kb_slug(F.col("c_mktsegment")).alias("slug")).agg(F.count("*").alias("n"))


@registered("""
SELECT DISTINCT 'o' || (c_nationkey % 3) AS owner_id, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer""")
def knowledge_base_create(spark, sf_dir):
    """Idempotent on owner and slug."""
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_nationkey") % 3).alias("owner_id"), F.col("c_mktsegment").alias("name"))
    one = catalog.create_knowledge_bases(new.limit(0).withColumn("slug", F.lit("")), new.where("owner_id = 'o1'"))
    return catalog.create_knowledge_bases(one, new).select("owner_id", "slug")


@registered("""
SELECT o_custkey AS kb_id, max(o_orderkey) AS ontology_id, count(*) AS versions FROM orders GROUP BY 1""")
def ontology_latest(spark, sf_dir):
    """Versions are numbered as they are added; the current one is the last."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ontology_id"), F.col("o_custkey").alias("kb_id"), F.lit(None).cast("string").alias("document_id"))
    none = o.limit(0).withColumn("version", F.lit(0))
    halves = catalog.add_ontologies(catalog.add_ontologies(none, o.where("ontology_id <= 500")), o.where("ontology_id > 500"))
    return catalog.current_ontologies(halves).select("kb_id", "ontology_id", F.col("version").cast("long").alias("versions"))


@registered("""
SELECT n_nationkey AS document_id, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def document_with_chunks(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    docs = catalog.with_chunks(n.select(F.col("n_nationkey").alias("document_id")), c.select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("idx"), F.col("c_name").alias("content")))
    joined = F.array_join(F.transform("chunks", lambda x: x["content"]), ",")
    return docs.select("document_id", F.when(F.size("chunks") > 0, joined).alias("names"))


@registered("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def list_newest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "created_at")
    return catalog.newest_first(o, "o_orderkey", 20).select("o_orderkey", F.col("created_at").alias("o_orderdate"))


@registered("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 ELSE p_size % 3 = 0 END AS valid FROM part""")
def category_check(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.when(s % 2 == 0, "Named Entity").otherwise("Concept/Idea")
    category = F.when(s % 2 == 0, F.when(s % 4 == 0, "people").otherwise("ideas")).otherwise(F.when(s % 3 == 0, "theories").otherwise("events"))
    return p.select("p_partkey", catalog.category_is_valid(kind, category).alias("valid"))


@registered("SELECT p_partkey, p_size % 3 <> 2 AS is_csv FROM part")
def file_type_check(spark, sf_dir):
    s = F.col("p_size") % 3
    name, mime = F.when(s == 0, "A.CSV").otherwise("a.txt"), F.when(s == 1, "Text/CSV")
    return table(spark, sf_dir, "part").select("p_partkey", catalog.is_csv(name, mime).alias("is_csv"))


@registered("""
SELECT user_id, count(*) AS total_cards, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-02') AS cards_due, round(avg(value), 6) AS average_ease,
  count(*) FILTER (WHERE ts::DATE = DATE '2024-01-02') AS reviewed_today FROM events GROUP BY 1""")
def user_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("due_at"), F.col("value").alias("ease"), F.col("ts").alias("reviewed_at"))
    return query.user_statistics(e, F.lit("2024-01-02").cast("timestamp")).withColumn("average_ease", F.round("average_ease", 6))


@registered("""
SELECT event_id AS card_id FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND ts <= TIMESTAMP '2030-01-01' ORDER BY ts, event_id LIMIT 10""")
def due_cards(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = e.agg(F.min("user_id")).first()[0]
    cards = e.select("user_id", F.col("event_id").alias("card_id"), F.col("ts").alias("due_at"))
    return catalog.due_cards(cards, user, F.lit("2030-01-01").cast("timestamp"), 10).select("card_id")


@registered(f"""
WITH {BASE_SQL}, l AS (SELECT DISTINCT node_id FROM nodes WHERE document_id IN ('doc1', 'doc2')),
s AS (SELECT src, dst FROM edges WHERE document_id IN ('doc1', 'doc2') OR src IN (FROM l) OR dst IN (FROM l))
SELECT node_id FROM l UNION SELECT src FROM s UNION SELECT dst FROM s""")
def visible_nodes(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.visible_subgraph(with_documents(n), e, ["doc1", "doc2"])[0].select("node_id")


@registered(f"""
WITH {BASE_SQL} SELECT d.document_id, d.title FROM docs d WHERE d.document_id IN (SELECT document_id FROM nodes WHERE node_id = 'customer:1')""")
def linked_documents(spark, sf_dir):
    n, _, d = base_graph(spark, sf_dir)
    return store.linked_documents(d, with_documents(n), "customer:1").select("document_id", "title")


@registered(f"WITH {BASE_SQL} SELECT d.document_id FROM docs d WHERE d.document_id NOT IN (SELECT document_id FROM nodes WHERE node_id = 'customer:1')")
def available_documents(spark, sf_dir):
    n, _, d = base_graph(spark, sf_dir)
    return store.linked_documents(d, with_documents(n), "customer:1", False).select("document_id")


@registered(f"WITH {BASE_SQL} SELECT node_id, document_id FROM nodes WHERE document_id = 'doc5'")
def document_entities(spark, sf_dir):
    return store.document_entities(base_graph(spark, sf_dir)[0], "doc5").select("node_id", "document_id")


@registered(f"WITH {BASE_SQL} SELECT src, predicate, dst FROM edges WHERE document_id = 'doc5'")
def document_relationships(spark, sf_dir):
    return store.document_relationships(base_graph(spark, sf_dir)[1], "doc5").select("src", "predicate", "dst")


@registered(f"WITH {BASE_SQL} SELECT src, predicate, dst FROM edges WHERE src <> 'nation:3' AND dst <> 'nation:3'")
def remove_node(spark, sf_dir):
    n, e, _ = base_graph(spark, sf_dir)
    return store.remove_node(n, e, "nation:3")[1].select("src", "predicate", "dst")


@registered(f"WITH {BASE_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges")
def undirected_edges(spark, sf_dir):
    _, e, _ = base_graph(spark, sf_dir)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return store.undirected(both)


@registered("SELECT event_id, event_type FROM events")
def insert_missing(spark, sf_dir):
    """Insert or leave: known keys stay as they are."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return store.insert_missing(e.where("event_id % 2 = 0"), e.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "changed").otherwise(F.col("event_type"))), ["event_id"])


@registered("""
SELECT o_orderkey, upper(trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '_', 'g'), '_')) AS predicate FROM orders WHERE o_orderkey % 2 = 0""")
def relation_types(spark, sf_dir):
    """Relations as arrays: those with fewer than three parts are left out, types cleaned."""
    o = table(spark, sf_dir, "orders")
    rel = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return store.whole_relations(o.select(rel.alias("relation"))).select(F.col("src").cast("long").alias("o_orderkey"), "predicate")


@registered("""
SELECT l_linenumber AS page_number, count(*) AS chunks FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 5""")
def page_distribution(spark, sf_dir):
    return chunk.page_distribution(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("page_number")))


@registered("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def markdown_table(spark, sf_dir):
    return profile.markdown_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@registered("SELECT doc_id, '{\"id\":' || doc_id || '}' AS json FROM documents")
def json_from_reply(spark, sf_dir):
    reply = F.concat(F.lit("Here:\n```json\n{\"id\": "), "doc_id", F.lit("}\n```\n"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.json_from_reply(reply).alias("json"))


@registered("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Page 2 of 9' ELSE 'Chunk 4' END || ' | ' || source AS context FROM documents""")
def chunk_context(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    page = F.when(even, 2)
    return table(spark, sf_dir, "documents").select("doc_id", texts.chunk_context(page, F.lit(9), F.lit(4), F.col("source")).alias("context"))


@registered("SELECT doc_id, lang || ',x' AS tags, 'topic' || ',' || lang AS categories FROM documents")
def enrich_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    arrays = d.select("doc_id", F.array("lang", "lang").alias("tags"), F.array(F.lit("x"), F.col("lang")).alias("topics"), F.array(F.lit("topic")).alias("categories"), F.array("lang").alias("keywords"))
    out = extract.enrich_metadata(arrays)
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"), F.array_join("categories", ",").alias("categories"))


@registered(f"""
WITH {MENTIONS_SQL} SELECT entity_id, resolved_id, CASE WHEN entity_id LIKE '%1' THEN 'exact' ELSE 'manual' END AS strategy, CASE WHEN entity_id LIKE '%2' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM m""")
def map_defaults(spark, sf_dir):
    """Rows of a resolution map with what they lack."""
    m = resolve.resolution_map(mentions(spark, sf_dir), fold=False)
    m = m.withColumn("strategy", F.when(~F.col("entity_id").like("%1"), "manual")).withColumn("confidence", F.when(F.col("entity_id").like("%2"), 0.5))
    return resolve.filled_map(m)


@registered(f"""
WITH {MENTIONS_SQL}, {RELATIONS_SQL} SELECT rid AS resolved_relationship_id, relationship_id, document_id FROM p""")
def resolution_provenance(spark, sf_dir):
    t = resolve.resolve(mentions(spark, sf_dir), relations(spark, sf_dir), fold=False)
    return t["resolved_relationship_mentions"].select("resolved_relationship_id", "relationship_id", "document_id")


@registered(f"""
WITH {MENTIONS_SQL}, d AS (SELECT * FROM m WHERE document_id IN ('d0', 'd2'))
SELECT resolved_id, count(*) AS mention_count FROM d GROUP BY 1""")
def resolve_documents(spark, sf_dir):
    """Resolution of some documents only."""
    m = resolve.in_scope(mentions(spark, sf_dir), ["d0", "d2"])
    return resolve.resolved_entities(m, fold=False).select("resolved_id", "mention_count")


@registered("""
SELECT DISTINCT sha256(array_to_string(['1', 'doc' || c_nationkey, 'customer:' || c_custkey], chr(31))) AS entity_key, 'customer:' || c_custkey AS node_id FROM customer WHERE c_nationkey = 3""")
def stored_nodes(spark, sf_dir):
    """Stable keys for the rows of a store."""
    n = base_graph(spark, sf_dir)[0].where("document_id = 'doc3' and type = 'customer'").withColumn("properties", F.lit(None).cast("map<string,string>"))
    return store.stored_nodes(n, 1, "doc3").select("entity_key", "node_id")


@registered(f"""
WITH {BASE_SQL}, c AS (SELECT node_id FROM nodes WHERE type = 'customer')
SELECT src, predicate, dst, 1.0::DOUBLE AS confidence FROM edges WHERE src IN (FROM c) AND dst IN (FROM c)
UNION ALL SELECT src, predicate, dst, 1.0 FROM edges WHERE predicate = 'lives_in' AND document_id = 'doc3'""")
def stored_edges(spark, sf_dir):
    """Only edges whose ends are both among the saved nodes."""
    n, e, _ = base_graph(spark, sf_dir)
    own = n.where("document_id = 'doc3' and type <> 'order'")
    return store.stored_edges(e.select("src", "predicate", "dst"), own, 1, "doc3").select("src", "predicate", "dst", "confidence")


@registered(f"WITH {BASE_SQL} SELECT component, count(*) AS size FROM (SELECT DISTINCT node_id, min(node_id) OVER (PARTITION BY document_id) AS component FROM nodes) GROUP BY 1")
def communities(spark, sf_dir):
    """Sizes of the base graph's connected components."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.communities(n.select("node_id").distinct(), e)


@registered(f"""
WITH {BASE_SQL}, t AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)
SELECT n AS nodes, e AS edges, e::DOUBLE / (n::DOUBLE * (n - 1)::DOUBLE) AS density, 2 * e::DOUBLE / n::DOUBLE AS average_degree, (SELECT count(*) FROM docs) AS documents,
  (SELECT count(DISTINCT document_id) FROM nodes) AS components, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS isolates FROM t""")
def graph_metrics(spark, sf_dir):
    n, e, d = base_graph(spark, sf_dir)
    return analytics.metrics(n, e, d)


from weftline import match_queries, phrase_queries, schema_queries, source_queries, state_queries, store_queries, text_queries  # noqa: E402, F401  (they register more)
