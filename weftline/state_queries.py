"""Registered queries of what is kept: maintained state, commits, indexes, and of
graph measures in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import analytics, search
from weftline.operators.iterate import shared_folder
from weftline.queries import BASE_SQL, MENTIONS_SQL, base_graph, mentions, registered, table
from weftline.sources.tables import TableSet
from weftline.streaming.state import MaintainedResolver, closed_windows

DAY = "c_custkey % 365"


def folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/query-{tag}-{uuid.uuid4().hex}"


def fed(spark, path: str, df, schema):
    """A stream over a folder that gets ``df`` as one more file."""
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


@registered(f"""
WITH {MENTIONS_SQL},
k AS (SELECT m.*, date_diff('day', TIMESTAMP '2020-01-01', created_at) AS day, substr(entity_id, 2)::BIGINT % 10 AS d FROM m),
s AS (SELECT * FROM k WHERE day >= 100 OR d <> 3),
n AS (SELECT resolved_id, name, count(*) AS c FROM s GROUP BY ALL),
f AS (SELECT resolved_id, name FROM n QUALIFY row_number() OVER (PARTITION BY resolved_id ORDER BY c DESC, length(name) DESC, name) = 1)
SELECT s.resolved_id, f.name, normalized_key, count(*) AS mention_count, count(DISTINCT document_id) AS doc_count, min(day) AS first_day, max(day) AS last_day FROM s JOIN f USING (resolved_id) GROUP BY ALL""")
def maintained_resolution(spark, sf_dir):
    """Entities from state: mentions of a hundred days; then, from a restarted stream,
    some of them again, some that are late, and all later ones."""
    own, files, m = folder(spark, "maintained"), folder(spark, "mentions"), mentions(spark, sf_dir)
    day, tenth = F.datediff("created_at", F.lit("2020-01-01").cast("date")), F.substr("entity_id", F.lit(2)).cast("long") % 10
    MaintainedResolver(spark, own, "10 days", fold=False).start(fed(spark, files, m.where((day < 100) & (tenth != 3)), m.schema)).awaitTermination()
    again, late = (day >= 91) & (day < 100) & (tenth != 3), (day < 80) & (tenth == 3)
    two = MaintainedResolver(spark, own, "10 days", fold=False)
    two.start(fed(spark, files, m.where(again | late | (day >= 100)), m.schema)).awaitTermination()

    def days(c):
        return F.datediff(c, F.lit("2020-01-01").cast("date")).cast("long")

    return two.entities().select("resolved_id", "name", "normalized_key", "mention_count", "doc_count", days("first_seen_at").alias("first_day"), days("last_seen_at").alias("last_day"))


@registered("""
WITH s AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_id % 10 <> 0)
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM s GROUP BY ALL
HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM s)""")
def streamed_windows_closed(spark, sf_dir):
    """Windows of a stream in append mode, each once it is closed. After a restart
    come rows that are a day and more late, which count nowhere, and all later ones."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    kind = e.schema["ts"].dataType
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    files, progress, out = (folder(spark, t) for t in ("events", "progress", "closed"))
    tenth, cut = F.col("event_id") % 10 == 0, F.lit("2024-01-20").cast("timestamp")
    for part in ((F.col("ts") < cut) & ~tenth, ((F.col("ts") < cut - F.expr("interval 1 day")) & tenth) | (F.col("ts") >= cut)):
        counts = closed_windows(fed(spark, files, e.where(part), e.schema))
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.col("start").cast(kind))


@registered(f"""
WITH {BASE_SQL}
SELECT 'node' AS kind, type AS what, count(*) AS n, count(*) FILTER (WHERE label LIKE '%!') AS changed FROM (SELECT node_id, type, CASE WHEN type = 'nation' THEN label || '!' ELSE label END AS label FROM nodes) GROUP BY type
UNION ALL SELECT 'edge', predicate, count(*), 0 FROM (SELECT DISTINCT src, predicate, dst FROM edges) GROUP BY predicate""")
def graph_committed(spark, sf_dir):
    """A graph saved in three commits of both its tables, with a change to some nodes;
    a commit that fails half way is not there."""
    nodes, edges, _ = base_graph(spark, sf_dir)
    nodes, edges = nodes.select("node_id", "type", "label"), edges.select("src", "predicate", "dst").distinct()
    t = TableSet(spark, folder(spark, "graph"), buckets=8)
    keys = {"nodes": ["node_id"], "edges": ["src", "predicate", "dst"]}

    def save(n, e):
        t.upsert({"nodes": (n, keys["nodes"]), "edges": (e, keys["edges"])})

    save(nodes.where("type <> 'order'"), edges.where("predicate = 'lives_in'"))
    save(nodes.where("type = 'order'"), edges.where("predicate = 'placed'"))

    def fails(tables):
        if t.written(nodes.limit(1)):
            raise OSError("no space left")

    try:
        t.commit(fails)
    except OSError:
        pass
    save(nodes.where("type = 'nation'").withColumn("label", F.concat("label", F.lit("!"))), edges.where("predicate = 'lives_in'"))
    got = t.read()
    one = got["nodes"].groupBy(F.lit("node").alias("kind"), F.col("type").alias("what")).agg(F.count("*").alias("n"), F.count_if(F.col("label").like("%!")).alias("changed"))
    return one.unionByName(got["edges"].groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("what")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("changed")))


# -- search by index ----------------------------------------------------------------


@registered(f"""
WITH {BASE_SQL}
SELECT label AS name, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents FROM nodes WHERE contains(lower(label), '00012') GROUP BY 1 ORDER BY 1 LIMIT 10""")
def entities_indexed(spark, sf_dir):
    """Search by label in an index that two batches were added to."""
    nodes = base_graph(spark, sf_dir)[0].select("node_id", "type", "label", "document_id")
    index = search.TrigramIndex(spark, folder(spark, "index"), ["label"], buckets=16)
    index.add(nodes.where("type = 'customer'"))
    index.add(nodes.where("type <> 'customer'"))
    return search.entities_found(index, "00012").select("name", F.array_join("documents", ",").alias("documents"))


@registered(f"""
WITH {BASE_SQL} SELECT DISTINCT src, predicate, dst FROM edges WHERE contains(lower(src), 'er:12') OR contains(lower(predicate), 'er:12') OR contains(lower(dst), 'er:12') ORDER BY 1, 2, 3 LIMIT 10""")
def relationships_indexed(spark, sf_dir):
    index = search.TrigramIndex(spark, folder(spark, "index"), ["src", "predicate", "dst"], buckets=16)
    index.add(base_graph(spark, sf_dir)[1])
    return search.relationships_found(index, "er:12")


@registered("""
SELECT doc_id FROM documents WHERE contains(lower(text), 'on the')""")
def texts_indexed(spark, sf_dir):
    """Search in whole texts by an index of all their trigrams."""
    index = search.TrigramIndex(spark, folder(spark, "index"), ["text"], buckets=16)
    index.add(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search("on the").select("doc_id")


@registered("""
SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the on')""")
def texts_in_a_merged_index(spark, sf_dir):
    """An index that every source was added to by itself, merged half way and at the
    end: it finds what a scan finds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = search.TrigramIndex(spark, folder(spark, "index"), ["text"], buckets=8)
    for k in range(4):
        index.add(d.where(F.pmod(F.hash("source"), F.lit(4)) == k))
        if k % 2:
            index.merge()
    return index.search("the on").select("doc_id", "source")


# -- measures in rounds -----------------------------------------------------------------

TURN_PAIRS = "y AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), z AS MATERIALIZED (SELECT DISTINCT a, b FROM y WHERE a <> b)"


def _colouring_sql(rounds: int) -> list[str]:
    steps = ["k0 AS MATERIALIZED (SELECT DISTINCT node_id, md5(node_id) AS h, NULL::INTEGER AS c FROM nodes)"]
    for i in range(rounds):
        steps.append(f"""k{i + 1} AS MATERIALIZED (
  SELECT k.node_id, k.h, CASE WHEN k.c IS NOT NULL THEN k.c WHEN max(o.h) FILTER (WHERE o.c IS NULL) IS NULL OR k.h > max(o.h) FILTER (WHERE o.c IS NULL)
    THEN list_min(list_filter(range(0, 1 + count(DISTINCT o.c)), lambda x: NOT list_contains(coalesce(list(DISTINCT o.c) FILTER (WHERE o.c IS NOT NULL), []), x)))::INTEGER END AS c
  FROM k{i} k LEFT JOIN z ON z.a = k.node_id LEFT JOIN k{i} o ON o.node_id = z.b GROUP BY k.node_id, k.h, k.c)""")
    return steps


ROUNDS, COLOURS = 24, 5


@registered(f"WITH {BASE_SQL}, {TURN_PAIRS}, {', '.join(_colouring_sql(ROUNDS))} SELECT node_id, c AS colour FROM k{ROUNDS}")
def graph_colouring(spark, sf_dir):
    """Colours of the whole base graph; neighbours differ."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.colouring(n, e)


def _in_turn_sql(iterations: int) -> str:
    steps = [*_colouring_sql(ROUNDS), "l0 AS MATERIALIZED (SELECT node_id, c, node_id AS l FROM k{0})".format(ROUNDS)]
    for i in range(iterations * COLOURS):
        steps.append(f"""l{i + 1} AS MATERIALIZED (
  WITH v AS (SELECT a, x.l, count(*) AS w FROM y JOIN l{i} x ON x.node_id = y.b JOIN l{i} s ON s.node_id = y.a WHERE s.c = {i % COLOURS} GROUP BY ALL),
  t AS (SELECT a, l FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, l) = 1)
  SELECT node_id, c, coalesce(t.l, p.l) AS l FROM l{i} p LEFT JOIN t ON t.a = p.node_id)""")
    return f"WITH {BASE_SQL}, {TURN_PAIRS}, {', '.join(steps)} SELECT node_id, l AS community FROM l{iterations * COLOURS}"


@registered(_in_turn_sql(8))
def label_propagation_in_turn(spark, sf_dir):
    """Communities of the whole base graph, colours in turn, after 8 rounds at most."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.label_propagation_in_turn(n, e, 8)


@registered()
def closeness_estimated(spark, sf_dir):
    """Of all nodes of the base graph, by sketches."""
    n, e, _ = base_graph(spark, sf_dir)
    return analytics.closeness_estimated(n, e, lg_k=10)
