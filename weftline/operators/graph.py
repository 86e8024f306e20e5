"""Tables to property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.mapping import MappingSpec, cell, compiled_edges, entity_column, label_column


def edges(df: DataFrame, spec: MappingSpec) -> DataFrame:
    """Distinct (src, predicate, dst); an edge without either id is left out."""
    made = [F.struct(s.alias("src"), F.lit(p).alias("predicate"), t.alias("dst")) for p, s, t in compiled_edges(spec, df.columns)]
    if not made:
        return df.sparkSession.createDataFrame([], "src string, predicate string, dst string")
    return df.select(F.inline(F.array(*made))).where("src is not null and dst is not null").distinct()


def nodes(df: DataFrame, spec: MappingSpec) -> DataFrame:
    """Distinct node_id: what the entities' keys give, and the ends of edges."""
    ids = [entity_column(spec, n, df.columns) for n in spec.entities]
    for p, s, t in compiled_edges(spec, df.columns):
        both = s.isNotNull() & t.isNotNull()
        ids += [F.when(both, s), F.when(both, t)]
    if not ids:
        return df.sparkSession.createDataFrame([], "node_id string")
    return df.select(F.explode(F.array_distinct(F.array(*ids))).alias("node_id")).where("node_id is not null").distinct()


def labelled_nodes(df: DataFrame, spec: MappingSpec, order: str) -> DataFrame:
    """(node_id, type, label, properties): of the rows that name a node, by
    ``order`` (a column that orders the rows), the first non-blank value of each
    property and label; the first entity that names it gives the type. One scan;
    the aggregate combines before its shuffle."""
    rows = []
    attributes = sorted({a.name for e in spec.entities.values() for a in e.attributes if a.column})
    for n, (name, e) in enumerate(spec.entities.items()):
        node_id = entity_column(spec, name, df.columns)
        own = {a.name: cell(a.column, df.columns) for a in e.attributes if a.column}
        label = label_column(e, df.columns, F.lit(None).cast("string"))
        rows.append(F.struct(node_id.alias("node_id"), F.lit(n).alias("ent"), F.lit(name.lower()).alias("type"), label.alias("label"), *[own.get(a, F.lit("")).alias(f"p{i}") for i, a in enumerate(attributes)]))
    if not rows:
        return df.sparkSession.createDataFrame([], "node_id string, type string, label string, properties map<string,string>")
    flat = df.select(F.col(order).alias("ord"), F.inline(F.array(*rows))).where("node_id is not null")
    at = F.struct("ord", "ent")

    def first(c: str):
        blank = F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
        return F.min_by(F.when(~blank, F.col(c)), F.when(~blank, at))

    merged = flat.groupBy("node_id").agg(F.min_by("type", at).alias("type"), first("label").alias("label"), *[first(f"p{i}").alias(f"p{i}") for i in range(len(attributes))])
    pairs = [F.when(F.col(f"p{i}").isNotNull(), F.struct(F.lit(a).alias("key"), F.col(f"p{i}").alias("value"))) for i, a in enumerate(attributes)]
    properties = F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return merged.select("node_id", "type", F.coalesce("label", "node_id").alias("label"), properties.alias("properties"))


def properties_long(labelled: DataFrame) -> DataFrame:
    """(node_id, attribute, value), one row a property."""
    return labelled.select("node_id", F.explode("properties").alias("attribute", "value"))


def graph(df: DataFrame, spec: MappingSpec) -> tuple[DataFrame, DataFrame]:
    return nodes(df, spec), edges(df, spec)


def merge_graphs(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Distinct union of graphs of the same columns."""
    all_nodes, all_edges = parts[0]
    for n, e in parts[1:]:
        all_nodes, all_edges = all_nodes.unionByName(n), all_edges.unionByName(e)
    return all_nodes.distinct(), all_edges.distinct()
