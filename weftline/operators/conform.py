"""How a table's rows conform to an ontology. Its headers are checked when it is
compiled (``ontology.validate``); this looks at the values: one pass counts what a
row shows by itself, one aggregate finds entities whose rows contradict each other,
and an anti-join for each table that is given finds ends that lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans import ontology

#: Declared types whose values are checked, and what a value must be read as.
TYPES = {
    "integer": "bigint", "int": "bigint", "long": "bigint",
    "float": "double", "double": "double", "number": "double", "decimal": "double",
    "date": "timestamp", "datetime": "timestamp", "timestamp": "timestamp",
    "boolean": "boolean", "bool": "boolean",
}
SCHEMA = "subject string, issue string, detail string, n long"
APART = "\x1f"


def there(c: str) -> Column:
    text = F.col(f"`{c}`").cast("string")
    return text.isNotNull() & (F.trim(text) != "")


def all_there(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & there(c)
    return out


def key_text(columns: list[str]) -> Column:
    return F.concat_ws(APART, *[F.col(f"`{c}`").cast("string") for c in columns])


def conformance(df: DataFrame, spec: dict, tables: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(subject, issue, detail, n) for what is wrong with rows, where n > 0:

    * ``key missing``: rows without an entity's whole key (detail: its columns);
    * ``not of its type``: values of an attribute that its declared type cannot hold;
    * ``values differ``: keys whose rows give an attribute more than one value;
    * ``one end missing``: rows that have one end of a relationship but not the other
      (subject: the predicate, detail: the column of the end that is missing);
    * ``not in its table``: different keys of an entity that the table given for it,
      with the column to look in, does not have (one-column keys).

    Null and blank values are missing, and missing values of attributes are no
    fault. Entities, attributes and ends without a column among the headers are left
    to ``ontology.validate``. An empty table has no faults.
    """
    spark, o, h = df.sparkSession, ontology.normalise(spec), ontology.Headers(df.columns)
    keys = {e.name: [h.find(k) for k in e.keys] for e in o.entities}
    keys = {name: cols for name, cols in keys.items() if cols and None not in cols}
    counted: list[tuple[str, str, str, Column]] = [(name, "key missing", ",".join(cols), ~all_there(cols)) for name, cols in keys.items()]
    stated = []
    for e in o.entities:
        for a in e.attributes:
            column = h.find(a.name)
            if column is None:
                continue
            kind = TYPES.get(str(a.type or "").strip().lower())
            if kind:
                counted.append((e.name, "not of its type", a.name, there(column) & F.trim(F.col(f"`{column}`").cast("string")).try_cast(kind).isNull()))
            if column not in keys.get(e.name, [column]):
                stated.append(F.struct(F.lit(e.name).alias("subject"), F.lit(a.name).alias("detail"), F.when(all_there(keys[e.name]) & there(column), key_text(keys[e.name])).alias("key"), F.col(f"`{column}`").cast("string").alias("value")))
    for r in o.relationships:
        ends = []
        for name, column in ((r.source, r.source_col), (r.target, r.target_col)):
            e, found = o.entity(name), h.find(column)
            ends.append([found] if found else keys.get(e.name if e else "", []))
        if all(ends):
            for own, other in (ends, reversed(ends)):
                counted.append((r.predicate, "one end missing", ",".join(other), all_there(own) & ~all_there(other)))

    parts = []
    if counted:
        once = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (*_, test) in enumerate(counted)])
        parts.append(once.select(F.inline(F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(issue).alias("issue"), F.lit(d).alias("detail"), F.col(f"c{i}").alias("n")) for i, (s, issue, d, _) in enumerate(counted)]))).where("n > 0"))
    if stated:
        values = df.select(F.inline(F.array(*stated))).where("key is not null").groupBy("subject", "detail", "key").agg(F.min("value").alias("least"), F.max("value").alias("most"))
        parts.append(values.where("least <> most").groupBy("subject", "detail").agg(F.count("*").alias("n")).select("subject", F.lit("values differ").alias("issue"), "detail", "n"))
    for name, (other, column) in (tables or {}).items():
        e = o.entity(name)
        cols = keys.get(e.name if e else "", [])
        if len(cols) != 1:
            continue
        have = df.where(there(cols[0])).select(key_text(cols).alias("key")).distinct()
        known = other.where(there(column)).select(key_text([column]).alias("key")).distinct()
        parts.append(have.join(known, "key", "left_anti").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(e.name).alias("subject"), F.lit("not in its table").alias("issue"), F.lit(cols[0]).alias("detail"), "n"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return spark.createDataFrame([], SCHEMA) if out is None else out.select("subject", "issue", "detail", F.col("n").cast("long").alias("n"))
