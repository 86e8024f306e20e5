"""Registered queries of chunking and extraction whose SQL states what holds for
every document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import chunk, extract
from weftline.queries import ORACLE, registered, table

SIZE = 1000


def cover(chunks, key: str):
    """(key, shown, longest, rest): non-blank characters of the chunks, each once;
    the longest chunk; how often a chunk's content has another length than its span
    or blanks at an end."""
    order = Window.partitionBy(*key.split(",")).orderBy("start", "end")
    until = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.substr("content", F.greatest(F.lit(1), F.col("until") - F.col("start") + 1))
    wrong = (F.length("content") != F.col("end") - F.col("start")) | F.col("content").rlike(r"(?U)^\s|\s$")
    c = chunks.withColumn("until", until).select(*key.split(","), F.length(F.regexp_replace(fresh, "(?U)" + r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "")).alias("n"), F.length("content").alias("size"), wrong.alias("wrong"))
    return c.groupBy(*key.split(",")).agg(F.sum("n").cast("long").alias("shown"), (F.max("size") <= SIZE).alias("fits"), F.count_if("wrong").alias("wrong"))


SHOWN = r"length(regexp_replace(text, '[\s\p{Z}\x0B\x1c-\x1f\x{85}]+', '', 'g'))"


@registered(f"SELECT doc_id AS document_id, {SHOWN} AS shown, true AS fits, 0 AS wrong FROM documents WHERE {SHOWN} > 0")
def chunk_cover(spark, sf_dir):
    """Chunks of a document hold all its non-blank characters, none is longer than
    allowed, and each is what stands at its place."""
    return cover(chunk.chunk_documents(table(spark, sf_dir, "documents"), SIZE, id_col="doc_id"), "document_id")


def ten_lines(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10)), lambda i: F.array_join(F.slice(lines, (i * 10 + 1).cast("int"), 10), "\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(pages, "\f").alias("text"))


@registered(r"""
WITH p AS (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 9) // 10 + 1)) AS page, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id AS document_id, page::INTEGER AS page_number, length(regexp_replace(array_to_string(l[page * 10 - 9:page * 10], ''), '[\s\p{Z}\x0B\x1c-\x1f\x{85}]+', '', 'g')) + 2 * length(page::VARCHAR) + 2 AS shown, true AS fits, 0 AS wrong FROM p""")
def chunked_pages(spark, sf_dir):
    """Every ten lines of a document as a page between lines of its own: its chunks
    hold all non-blank characters of the page. (No line ends in a hyphen.)"""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "-$", "="))
    page = lambda i: F.array_join(F.slice(lines, (i * 10 - 9).cast("int"), 10), "\n")
    pages = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.size(lines) / 10)), lambda i: F.concat(F.lit("P"), i.cast("string"), F.lit("\n"), page(i), F.lit("\nQ"), i.cast("string")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(pages, "\f").alias("text"))
    return cover(chunk.chunk_pages(d, SIZE), "document_id,page_number")


@registered("SELECT doc_id AS document_id, 0 AS wrong FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def chunk_chain(spark, sf_dir):
    """Page chunks are numbered without gaps, know their neighbours, are cut as their
    strategy says and begin at their page's cursor."""
    c = chunk.chunk_pages(ten_lines(spark, sf_dir))
    w, page = Window.partitionBy("document_id").orderBy("idx"), Window.partitionBy("document_id", "page_number")
    key = lambda i: F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), i.cast("string"))
    last = F.lead("idx").over(w).isNull()
    good = (
        (F.col("idx") == F.row_number().over(w) - 1) & (F.col("chunk_id") == key(F.col("idx")))
        & F.col("prev_id").eqNullSafe(F.when(F.col("idx") > 0, key(F.col("idx") - 1))) & F.col("next_id").eqNullSafe(F.when(~last, key(F.col("idx") + 1)))
        & (F.col("strategy") == F.when(F.count("*").over(page) > 1, "page+recursive").otherwise("page"))
        & (F.length("content") <= 1000) & (F.col("end") - F.col("start") == F.length("content"))
        & (F.col("start") >= F.coalesce(F.lag("start").over(page.orderBy("idx")), F.lit(0))))
    return c.select("document_id", (~good).alias("bad")).groupBy("document_id").agg(F.count_if("bad").alias("wrong"))


LEVEL = "(k * k + k // 3 + doc_id) % 6 + 1"
#: Every line of a document as a section of its own, longer than half a chunk, under a heading of any of the six levels.
HEADED_SQL = rf"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
h AS (SELECT doc_id, k, ({LEVEL})::INTEGER AS level, repeat('#', ({LEVEL})::INTEGER) || ' H' || k || CASE WHEN k % 4 = 0 THEN ' ##' ELSE '' END || chr(10) || '= ' || line || repeat(' ab', 170) AS body FROM l),
w AS (SELECT *, sum(length(body) + 1) OVER (PARTITION BY doc_id) - 1 AS size, {", ".join(f"max(CASE WHEN level = {i} THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS l{i}" for i in range(1, 5))} FROM h),
s AS (SELECT doc_id, body, CASE WHEN size <= {SIZE} THEN [] ELSE list_filter([l1, CASE WHEN l2 > coalesce(l1, 0) THEN l2 END, CASE WHEN l3 > greatest(coalesce(l1, 0), coalesce(l2, 0)) THEN l3 END, CASE WHEN l4 > greatest(coalesce(l1, 0), coalesce(l2, 0), coalesce(l3, 0)) THEN l4 END], lambda x: x IS NOT NULL) END AS path FROM w)"""


def headed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("k", F.col("at") + 1)
    level = ((F.col("k") * F.col("k") + F.floor(F.col("k") / 3) + F.col("doc_id")) % 6 + 1).cast("int")
    body = F.concat(F.repeat(F.lit("#"), level), F.lit(" H"), F.col("k").cast("string"), F.when(F.col("k") % 4 == 0, " ##").otherwise(""), F.lit("\n= "), "line", F.lit(" ab" * 170))
    parts = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", body.alias("body")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda p: p["body"]), "\n").alias("text"))


@registered(f"WITH {HEADED_SQL} SELECT doc_id AS document_id, array_to_string(list_transform(path, lambda x: 'H' || x), ' > ') AS section, sum({SHOWN.replace('text', 'body')})::BIGINT AS shown, true AS fits, 0 AS wrong FROM s GROUP BY ALL")
def structured_sections(spark, sf_dir):
    """Documents with headings of all six levels by their structure: each section has
    the path of the headings above it and all its own non-blank characters; headings
    below the fourth level belong to the section's text; no chunk is too long."""
    return cover(chunk.chunk_documents(headed(spark, sf_dir), SIZE, id_col="doc_id"), "document_id,section")


TYPED_SQL = f"""
t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '###### last' || chr(10) || 'end' WHEN 1 THEN text || chr(10) || '#none ####### none' WHEN 2 THEN text ELSE ' ' || chr(10) END AS text, doc_id % 4 AS kind FROM documents)"""


@registered(f"WITH {TYPED_SQL} SELECT doc_id AS document_id, CASE kind WHEN 1 THEN 'recursive' ELSE 'structured_markdown' END AS strategy, {SHOWN} AS shown, true AS fits, 0 AS wrong FROM t WHERE kind < 3 AND {SHOWN} > 0")
def chunk_strategies(spark, sf_dir):
    """How documents are cut: by structure where a heading of any level stands in the
    text or the type says Markdown, else recursively. Blank Markdown has no chunk."""
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat("text", F.lit("\n###### last\nend"))).when(kind == 1, F.concat("text", F.lit("\n#none ####### none"))).when(kind == 2, F.col("text")).otherwise(" \n")
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.when(kind >= 2, ".MD").otherwise("txt").alias("type"))
    return cover(chunk.chunk_documents(d, SIZE, id_col="doc_id", type_col="type"), "document_id,strategy")


#: A name, with what stands before it: a capital and letters, more such words after white space.
NAME_SQL = r"(^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_]+(?:\s+[A-Z][\p{L}\p{N}_]+)*)"
#: doc_id, sentence parts: text before the first name, then each name, chr(2) and what follows it.
PARTS_SQL = rf"""
s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]')) AS sentence FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 10),
p AS (SELECT doc_id, string_split(regexp_replace(sentence, '{NAME_SQL}', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS x FROM s),
r AS (SELECT doc_id, list_transform(x[2:], lambda y: string_split(y, chr(2))) AS y FROM p),
n AS (SELECT doc_id, y, unnest(range(1, len(y))) AS i FROM r),
e AS (SELECT doc_id, y[i][1] AS src, array_to_string(list_filter(regexp_split_to_array(y[i][2], '\s+'), lambda w: w <> '')[1:3], ' ') AS b, y[i + 1][1] AS dst FROM n)"""


@registered(rf"""
WITH {PARTS_SQL}
SELECT DISTINCT doc_id, src, CASE WHEN trim(regexp_replace(lower(b), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_') = '' THEN 'related_to' ELSE trim(regexp_replace(lower(b), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_') END AS predicate, dst FROM e""")
def extracted_relations(spark, sf_dir):
    """The default extractor's relations of all documents."""
    t = extract.extract(table(spark, sf_dir, "documents"), id_cols=("doc_id",))
    return t.where("predicate is not null").select("doc_id", "src", "predicate", "dst").distinct()


ORACLE["extract_triples"] = ORACLE["extracted_relations"].replace("SELECT DISTINCT doc_id, src", "SELECT DISTINCT src")


@registered(f"WITH {PARTS_SQL}, f AS (SELECT DISTINCT doc_id, unnest(list_transform(y, lambda z: z[1])) AS name FROM r) SELECT doc_id, string_agg(name, '|' ORDER BY name) AS names FROM f GROUP BY 1")
def extracted_entities(spark, sf_dir):
    """The names of each document, over all its chunks or all of it."""
    t = extract.extract(table(spark, sf_dir, "documents"), id_cols=("doc_id",))
    return extract.by_document(t, "doc_id").select("doc_id", F.array_join("entities", "|").alias("names"))


@registered("""
SELECT route, count(*) AS documents FROM (SELECT CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 100 THEN 'skip' WHEN length(text) // 4 >= 500 THEN 'chunk' ELSE 'document' END AS route FROM documents) WHERE route <> 'skip' GROUP BY 1""")
def extraction_routes(spark, sf_dir):
    """Documents by how they were read: whole or by chunks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    t = extract.extract_routed(d, lambda text: (["found"], []), 500)
    return t.groupBy("route").agg(F.count_distinct("document_id").alias("documents"))


@registered("SELECT doc_id, 'a,b,c,d,e' AS topics FROM documents")
def first_topics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.array(*map(F.lit, "abcdefg")).alias(c) for c in ("tags", "topics", "categories", "keywords")])
    return extract.enrich_metadata(d).select("doc_id", F.array_join("topics", ",").alias("topics"))


@registered("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c)
SELECT doc_id AS document_id, string_agg(word, ',' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY 1""")
def document_keywords(spark, sf_dir):
    k = extract.keywords(table(spark, sf_dir, "documents"), id_col="doc_id")
    return k.select("document_id", F.array_join("keywords", ",").alias("keywords"))


@registered("SELECT doc_id, lang || ',x' AS topics, 'n' || (length(text) % 7) AS keywords FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 10")
def described_documents(spark, sf_dir):
    """A stand-in for a model, on all documents: a topic that comes twice stays once."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat("lang", F.lit("|"), "text"))
    said = extract.described(d, lambda t: {"topics": [t.split("|")[0], "x", "x"], "keywords": [f"n{(len(t) - len(t.split('|')[0]) - 1) % 7}"]}, ("doc_id", "text"), "t")
    return said.where(F.length(F.trim("text", F.lit(" \t\n\r"))) > 10).select("doc_id", F.array_join("topics", ",").alias("topics"), F.array_join("keywords", ",").alias("keywords"))


@registered("""
SELECT issue, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'an end is missing' WHEN o_orderkey % 5 = 1 THEN 'no predicate' WHEN o_orderkey % 5 = 2 THEN 'a loop' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'unknown predicate'
  WHEN o_custkey % 2 = 1 THEN 'unknown node' ELSE 'none' END AS issue FROM orders) GROUP BY 1""")
def checked_relations(spark, sf_dir):
    """Relations with what speaks against them; those that stand have no issue."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 5, F.concat(F.lit("c"), "o_custkey")
    t = o.select("o_orderkey", c.alias("src"), F.when(k == 1, " ").otherwise(F.col("o_orderstatus")).alias("predicate"), F.when(k == 0, F.lit("")).when(k == 2, c).otherwise(F.concat(F.lit("o"), "o_orderkey")).alias("dst"))
    nodes = o.where("o_custkey % 2 = 0").select(c.alias("node_id")).union(o.select(F.concat(F.lit("o"), "o_orderkey")))
    good, bad = extract.checked(t, nodes, ["O", "F"])
    return bad.groupBy("issue").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("none").alias("issue"), "n"))
