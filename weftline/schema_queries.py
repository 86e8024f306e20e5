"""Registered queries of what is found out about tables: keys, dependencies, profiles
that are merged. The SQL asks of every candidate whether it holds."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from weftline.operators import conform, dependencies, profile_sketches
from weftline.operators.iterate import shared_folder
from weftline.plans import ontology
from weftline.queries import registered, table

#: The tables' columns, by kind: w whole numbers, s strings, t times, f floats. Fixed values.
COLUMNS = {
    "region": "r_regionkey:w r_name:s",
    "nation": "n_nationkey:w n_name:s n_regionkey:w",
    "customer": "c_custkey:w c_name:s c_nationkey:w c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:w s_name:s s_nationkey:w s_acctbal:f",
    "part": "p_partkey:w p_name:s p_brand:s p_type:s p_size:w p_retailprice:f",
    "orders": "o_orderkey:w o_custkey:w o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:w l_partkey:w l_suppkey:w l_linenumber:w l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
}
KINDS = {t: dict(c.split(":") for c in cs.split()) for t, cs in COLUMNS.items()}
EXACT = {t: [c for c, k in cs.items() if k != "f"] for t, cs in KINDS.items()}


def tables(spark, sf_dir):
    return {t: table(spark, sf_dir, t).select(*cs) for t, cs in KINDS.items()}


ONE_KEY = "k1 AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS cols WHERE (SELECT count(*) > 0 AND count(*) = count(DISTINCT {c}) FROM {t})" for t, cs in EXACT.items() for c in cs) + ")"


@registered(f"WITH {ONE_KEY} SELECT * FROM k1 UNION ALL " + " UNION ALL ".join(
    f"SELECT '{t}', '{a},{b}' WHERE NOT EXISTS (SELECT 1 FROM k1 WHERE tbl = '{t}' AND cols IN ('{a}', '{b}')) AND (SELECT count(*) > 0 AND count(*) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) FROM {t})"
    for t, cs in EXACT.items() for a, b in itertools.combinations(cs, 2)))
def discovered_keys(spark, sf_dir):
    """Minimal keys of one and two columns of all TPC-H tables."""
    found = [k for t, df in tables(spark, sf_dir).items() for k in dependencies.keys(df, t, 2)]
    return spark.createDataFrame([(k.table, ",".join(k.columns)) for k in found], "tbl string, cols string")


@registered(f"WITH {ONE_KEY} " + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, '{u}' AS of_tbl, '{d}' AS of_col, round((SELECT count(DISTINCT {c}) FROM {t}) / (SELECT count(*) FROM {u}), 9) AS coverage WHERE EXISTS (SELECT 1 FROM k1 WHERE tbl = '{u}' AND cols = '{d}') AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {d} FROM {u}))"
    for t, cs in EXACT.items() for c in cs for u, ds in EXACT.items() for d in ds if (t, c) != (u, d) and KINDS[t][c] == KINDS[u][d]))
def discovered_inclusions(spark, sf_dir):
    """Columns whose values are all values of a key: foreign keys, and those that look like one."""
    found = dependencies.inclusions(tables(spark, sf_dir))
    return spark.createDataFrame([(x.table, x.column, x.of_table, x.of_column, x.coverage) for x in found], "tbl string, col string, of_tbl string, of_col string, coverage double").withColumn("coverage", F.round("coverage", 9))


WIDE = ["c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]


@registered("WITH w AS (SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) " + " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{d}' AS determines WHERE (SELECT count(DISTINCT {c}) < count(*) AND count(DISTINCT {c}) > 1 AND count(DISTINCT {d}) > 1 FROM w) AND NOT EXISTS (SELECT 1 FROM w GROUP BY {c} HAVING count(DISTINCT {d}) > 1)"
    for c, d in itertools.permutations(WIDE, 2)))
def discovered_dependencies(spark, sf_dir):
    """Columns that determine another and are no key, of customers with their nations and regions."""
    t = tables(spark, sf_dir)
    wide = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(*WIDE)
    return spark.createDataFrame([(f.columns[0], f.determines) for f in dependencies.functional(wide, "customer", 1)], "col string, determines string")


STATED = ["l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_orderkey"]


@registered(" UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) - count({c}) AS nulls, '{kind}' AS inferred_type, {most} AS most, {n} AS most_count, true AS distinct_close, true AS median_close FROM lineitem"
    for c, kind, most, n in (
        (c, kind, *(("NULL", "NULL::BIGINT") if c in ("l_orderkey", "l_quantity") else (f"(SELECT {c}::VARCHAR FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", f"(SELECT count(*) FROM lineitem GROUP BY {c} ORDER BY 1 DESC LIMIT 1)")))
        for c, kind in zip(STATED, ("integer", "string", "string", "float", "integer")))))
def profiles_merged(spark, sf_dir):
    """Profiles of the line items of each year, stored as they come and merged: exact
    counts, types and (of columns with few values) most frequent values, and whether
    distinct counts are within 5 % and medians within 4 % of ranks."""
    items = table(spark, sf_dir, "lineitem")
    years = [r[0] for r in items.select(F.year("l_shipdate")).distinct().collect()]  # a few years at any scale
    t = profile_sketches.ProfileTable(spark, f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}")
    for y in years:
        t.add("lineitem", str(y), items.where(F.year("l_shipdate").eqNullSafe(F.lit(y))), STATED)
    p = t.profile("lineitem", items=1)
    medians = {r.name: r.quantiles[2] for r in p.where("quantiles is not null").collect()}  # one row a column
    exact = items.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in STATED], *[F.avg((F.col(c) < m).cast("int")).alias(f"b_{c}") for c, m in medians.items()], *[F.avg((F.col(c) <= m).cast("int")).alias(f"u_{c}") for c, m in medians.items()]).head()
    many = F.create_map(*[F.lit(x) for c in STATED for x in (c, exact[f"d_{c}"])])
    middle = F.create_map(*[F.lit(x) for c in STATED for x in (c, c not in medians or exact[f"b_{c}"] - 0.04 <= 0.5 <= exact[f"u_{c}"] + 0.04)])
    shown = ~F.col("name").isin("l_orderkey", "l_quantity")
    return p.select(
        "name", "non_null", "nulls", "inferred_type", F.when(shown, F.col("frequent")[0]["value"]).alias("most"), F.when(shown, F.col("frequent")[0]["count"]).alias("most_count"),
        (F.abs(F.col("distinct") - many[F.col("name")]) <= 0.05 * many[F.col("name")]).alias("distinct_close"), middle[F.col("name")].alias("median_close"))


#: Orders as they are kept elsewhere: what the given ontology says of them does not hold for all.
ORDERS_ONTOLOGY = {
    "entities": [
        {"name": "Order", "key": "o_orderkey", "attributes": [{"name": "o_orderpriority", "type": "integer"}, {"name": "o_totalprice", "type": "float"}]},
        {"name": "Customer", "key": "customer", "attributes": [{"name": "o_orderstatus"}]}],
    "relationships": [{"predicate": "placed", "source": "Customer", "target": "Order"}]}


@registered("""
WITH o AS (SELECT *, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_custkey END AS customer FROM orders)
SELECT 'Customer' AS subject, 'key missing' AS issue, 'customer' AS detail, count(*) AS n FROM o WHERE customer IS NULL HAVING count(*) > 0
UNION ALL SELECT 'Order', 'not of its type', 'o_orderpriority', count(*) FROM o WHERE try_cast(o_orderpriority AS BIGINT) IS NULL HAVING count(*) > 0
UNION ALL SELECT 'placed', 'one end missing', 'customer', count(*) FROM o WHERE customer IS NULL HAVING count(*) > 0
UNION ALL SELECT 'Customer', 'values differ', 'o_orderstatus', count(*) FROM (SELECT customer FROM o WHERE customer IS NOT NULL GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1) HAVING count(*) > 0
UNION ALL SELECT 'Customer', 'not in its table', 'customer', count(*) FROM (SELECT DISTINCT customer FROM o WHERE customer IS NOT NULL AND customer NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) HAVING count(*) > 0""")
def ontology_conformance(spark, sf_dir):
    """What speaks against an ontology in all orders."""
    o = table(spark, sf_dir, "orders").withColumn("customer", F.when(F.col("o_totalprice") > 300000, None).otherwise(F.col("o_custkey")))
    return conform.conformance(o, ORDERS_ONTOLOGY, {"Customer": (table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")})


#: Rows whose ids one task counts: what it holds does not grow with the table.
ROWS_A_TASK = 500_000


@registered("""
SELECT 'most relationships' AS way, 'Customer' AS entity, 'o_custkey' AS key_column, o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'key among headers', 'Order', 'o_orderkey', o_orderkey, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'first header', 'Thing', 'o_orderkey', o_orderkey, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'header in _id', 'Thing', 'cust_id', o_custkey, count(*) FROM orders GROUP BY ALL""")
def main_entities(spark, sf_dir):
    """The main entity of an ontology and its key column, picked in each of four
    ways, with how many rows each of its ids has in all orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    renamed = o.withColumnRenamed("o_custkey", "cust_id")
    ways = [
        ("most relationships", o, {"entities": {"Order": {"key": "o_orderkey"}, "Customer": {"key": "o_custkey"}}, "relationships": ["Customer -> Order", "Customer → Clerk", "Order | Clerk"]}),
        ("key among headers", o, {"entities": [{"name": "Clerk", "key": "clerk"}, {"name": "Order", "primary_key": ["o_orderkey"]}]}),
        ("first header", o, {"entities": [{"name": "Thing"}]}),
        ("header in _id", renamed, {"entities": [{"name": "Thing"}]})]
    # A fixed number of tasks is not made one again, as small shuffles of many different ids are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-o.count() // ROWS_A_TASK))
    out = None
    for way, df, spec in ways:
        entity, column = ontology.main_entity(ontology.normalise(spec), ontology.Headers(df.columns))
        part = df.repartition(tasks, column).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), F.lit(entity).alias("entity"), F.lit(column).alias("key_column"), "id", "n")
        out = part if out is None else out.unionAll(part)
    return out
