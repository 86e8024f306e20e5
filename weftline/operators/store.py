"""The graph store: snapshots, views, search, editing, upserts and deletion. A
store is a set of frames; writing is versioned by folder, never over what is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import names

from .analytics import distances


def scope(kb_id: int | str | None = None, document_id: str | None = None) -> Column:
    """A filter on knowledge base and document; a knowledge base that is no number does not filter."""
    c = F.lit(True)
    if kb_id is not None and str(kb_id).lstrip("-").isdigit():
        c = c & (F.col("kb_id") == int(kb_id))
    return c if document_id is None else c & (F.col("document_id") == document_id)


def snapshot(nodes: DataFrame, edges: DataFrame, documents: DataFrame, kb_id=None, document_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct nodes, edges and documents of a scope. A store partitioned by kb_id
    and document_id prunes by it."""
    c = scope(kb_id, document_id)
    return (
        nodes.where(c).select("node_id", "type", "label").distinct(),
        edges.where(c).select("src", "predicate", "dst").distinct(),
        documents.where(c).distinct(),
    )


def stored_nodes(nodes: DataFrame, kb_id, document_id: str) -> DataFrame:
    kb, doc = F.lit(kb_id).cast("long"), F.lit(document_id)
    return nodes.select(names.entity_key(kb, doc, F.col("node_id")).alias("entity_key"), kb.alias("kb_id"), doc.alias("document_id"), "node_id", "type", "label", "properties")


def stored_edges(edges: DataFrame, nodes: DataFrame, kb_id, document_id: str) -> DataFrame:
    """Edges both of whose ends are among the nodes, with a stable key and confidence 1."""
    kb, doc = F.lit(kb_id).cast("long"), F.lit(document_id)
    ids = nodes.select("node_id").distinct()
    known = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    key = names.entity_key(kb, doc, F.concat_ws("\x1f", "src", "predicate", "dst"))
    return known.select(key.alias("edge_key"), kb.alias("kb_id"), doc.alias("document_id"), "src", "predicate", "dst", F.lit(1.0).alias("confidence"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; of rows with one key the new one, and of several new ones the
    last by ``order``. Null keys are equal."""
    tagged = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"), *([F.desc_nulls_last(order)] if order else []))
    return tagged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; new rows whose key is known are left out."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``, descending."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edge_table(edges: DataFrame, nodes: DataFrame, documents: DataFrame, sort: str | None = None, ascending: bool = True) -> DataFrame:
    """(source, predicate, target, document): labels in place of ids, where there are
    any; the title of the edge's document, else of the source's first, else a dash.
    sort: a column, without regard to case."""
    label = nodes.select("node_id", "label", "documents")
    title = documents.select(F.col("document_id").alias("d"), "title")
    first = F.try_element_at("documents", F.lit(1))
    out = (
        edges.join(label.select(F.col("node_id").alias("src"), F.col("label").alias("s"), first.alias("fd")), "src", "left")
        .join(label.select(F.col("node_id").alias("dst"), F.col("label").alias("t")), "dst", "left")
        .join(title.select(F.col("d").alias("document_id"), F.col("title").alias("own")), "document_id", "left")
        .join(title.select(F.col("d").alias("fd"), F.col("title").alias("other")), "fd", "left")
        .select(F.coalesce("s", "src").alias("source"), "predicate", F.coalesce("t", "dst").alias("target"), F.coalesce("own", "other", F.lit("—")).alias("document"))
    )
    if sort:
        out = out.orderBy(F.lower(sort).asc() if ascending else F.lower(sort).desc(), "source", "predicate", "target")
    return out


def contains(c: str | Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query.lower()))


def search_entities(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(name, documents): labels that hold the query, without regard to case, in order."""
    docs = F.array_sort(F.collect_set("document_id"))
    return nodes.where(contains("label", query)).groupBy(F.col("label").alias("name")).agg(docs.alias("documents")).orderBy("name").limit(limit)


def search_relationships(edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    hit = contains("src", query) | contains("predicate", query) | contains("dst", query)
    return edges.where(hit).select("src", "predicate", "dst").distinct().orderBy("src", "predicate", "dst").limit(limit)


def entity_connections(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 2) -> DataFrame:
    """(entity, distance): what is reached from a node in ``depth`` steps."""
    start = nodes.where(F.col("node_id") == node_id)
    return distances(nodes, edges, start, depth).where("distance > 0").select(F.col("node_id").alias("entity"), "distance")


def document_entities(nodes: DataFrame, document_id: str) -> DataFrame:
    return nodes.where(F.col("document_id") == document_id)


def document_relationships(edges: DataFrame, document_id: str) -> DataFrame:
    return edges.where(F.col("document_id") == document_id)


def delete_document(tables: dict[str, DataFrame], document_id: str) -> dict[str, DataFrame]:
    """All tables without the document's rows."""
    return {n: t.where(~F.col("document_id").eqNullSafe(document_id)) if "document_id" in t.columns else t for n, t in tables.items()}


def statistics(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: distinct entities, documents and relationships."""
    e = nodes.agg(F.count_distinct("node_id").alias("entities"))
    d = documents.agg(F.count_distinct("document_id").alias("documents"))
    r = edges.agg(F.count_distinct("src", "predicate", "dst").alias("relationships"))
    return e.join(d, F.lit(True)).join(r, F.lit(True))  # one row each


def whole_relations(df: DataFrame, relation: str = "relation") -> DataFrame:
    """(src, predicate, dst) of relations given as arrays; shorter ones are left out."""
    r = F.col(relation)
    return df.where(F.size(r) >= 3).select(r[0].alias("src"), names.relation_type(r[1]).alias("predicate"), r[2].alias("dst"))


# -- editing --------------------------------------------------------------------


def merge_nodes(nodes: DataFrame, edges: DataFrame, keep: str, remove: str) -> tuple[DataFrame, DataFrame]:
    """One node out of two: ``keep`` takes the documents and edges of ``remove``, and
    its other columns only where it has none itself. Only the rows of the two meet in
    an aggregate; all other nodes pass through, and without a shuffle."""
    def move(c: str) -> Column:
        return F.when(F.col(c) == remove, keep).otherwise(F.col(c)).alias(c)

    two = F.coalesce(F.col("node_id").isin(keep, remove), F.lit(False))
    others = [c for c in nodes.columns if c not in ("node_id", "documents")]
    merged = nodes.where(two).withColumn("_own", F.col("node_id") == keep).withColumn("node_id", move("node_id")).groupBy("node_id").agg(
        *[F.max_by(c, "_own").alias(c) for c in others],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents"))
    moved = edges.select(*[move(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]).distinct()
    return nodes.where(~two).unionByName(merged.select(*nodes.columns)), moved


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (node_id, documents, ...) with new ones. Of a node that is known the
    new documents are added to the old, and other columns change where the new row
    has a value; of new rows with one id the first by its columns, as a whole, counts."""
    others = [c for c in nodes.columns if c not in ("node_id", "documents")]
    none = F.array().cast("array<string>")
    have = [c for c in others if c in new.columns]
    fresh = new.groupBy("node_id").agg(F.min(F.struct(*[F.col(c) for c in have] or [F.lit(1).alias("_none")])).alias("_row"), F.array_distinct(F.flatten(F.collect_list("documents"))).alias("_documents"))
    fresh = fresh.select("node_id", *[F.col("_row").getField(c).alias(f"_{c}") for c in have], "_documents")
    met = nodes.join(fresh, "node_id", "full")
    docs = F.array_union(F.coalesce("documents", none), F.coalesce("_documents", none))
    return met.select("node_id", *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in others], docs.alias("documents")).select(*nodes.columns)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None, keys: tuple[str, ...] = ("src", "predicate", "dst")) -> DataFrame:
    """Edges with those new ones that are not there yet by ``keys``; with ``nodes``
    given, only those both of whose ends are nodes."""
    if nodes is not None:
        ids = nodes.select("node_id").distinct()
        new = new.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return insert_missing(edges, new, list(keys))


def merge_extraction(nodes: DataFrame, edges: DataFrame, triples: DataFrame, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """A graph with what an extractor found (document, src, predicate, dst): nodes by
    id with the documents that name them, and edges that are not there yet. Known
    nodes keep their other columns; new ones have none."""
    doc = F.col(document).cast("string")
    named = triples.select(F.explode(F.array("src", "dst")).alias("node_id"), F.array(doc).alias("documents")).where("node_id is not null")
    found = triples.where("predicate is not null").select("src", "predicate", "dst", *([doc.alias("document_id")] if "document_id" in edges.columns else []))
    return add_nodes(nodes, named), add_edges(edges, found)


def remove_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("node_id") != node_id), edges.where((F.col("src") != node_id) & (F.col("dst") != node_id))


def remove_edge(edges: DataFrame, src: str, predicate: str, dst: str) -> DataFrame:
    return edges.where(~((F.col("src") == src) & (F.col("predicate") == predicate) & (F.col("dst") == dst)))


def update_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """Columns set to new values in the rows that meet a condition."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def link_document(nodes: DataFrame, node_id: str, document_id: str) -> DataFrame:
    return update_where(nodes, F.col("node_id") == node_id, documents=F.array_union("documents", F.array(F.lit(document_id))))


def unlink_document(nodes: DataFrame, node_id: str, document_id: str) -> DataFrame:
    return update_where(nodes, F.col("node_id") == node_id, documents=F.array_remove("documents", document_id))


def remove_document(nodes: DataFrame, edges: DataFrame, documents: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The document, its edges and the links to it go; nodes stay."""
    own = F.col("document_id").eqNullSafe(document_id)
    return nodes.withColumn("documents", F.array_remove("documents", document_id)), edges.where(~own), documents.where(~own)


def linked_documents(documents: DataFrame, nodes: DataFrame, node_id: str, linked: bool = True) -> DataFrame:
    """Documents that a node is linked to, or those that it is not."""
    own = nodes.where(F.col("node_id") == node_id).select(F.explode("documents").alias("document_id"))
    return documents.join(own, "document_id", "left_semi" if linked else "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Pairs once, whichever way they point."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
