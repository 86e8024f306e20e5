"""Profiles of text tables: one row a column, in one pass over the table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.normalizers import FALSE_WORDS, NUMBER, TRUE_WORDS, text, trim

#: Forms of dates: fixed values.
DATE_FORMS = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$")
INTEGER = r"^[+-]?\d+(_\d+)*$"


def long_form(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """(ord, col_no, name, value): one row a cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("name"), text(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(columns)])
    return df.select((F.col(order) if order else F.lit(0)).alias("ord"), F.inline(cells))


def type_tests(value: Column) -> dict[str, Column]:
    """What a single trimmed value must be for its column to have a type, in the order
    in which types are tried."""
    v = trim(value)
    date = F.lit(False)
    for form in DATE_FORMS:
        date = date | v.rlike(form)
    return {"integer": v.rlike(INTEGER), "float": v.rlike(NUMBER), "bool": F.lower(v).isin(*TRUE_WORDS[:3], *FALSE_WORDS[:1], "f", "no", "0", "1"), "date": date}


def first_type(holds: dict[str, Column]) -> Column:
    """The first type that holds; string, if none does."""
    types = F.lit("string")
    for name in reversed(holds):
        types = F.when(holds[name], name).otherwise(types)
    return types


def inferred_type(value: Column) -> Column:
    """Of a group's values, an aggregate: the first of integer, float, bool and date
    that all non-blank values are; string otherwise, and without values."""
    seen = trim(value) != ""
    return first_type({name: F.coalesce(F.bool_and(F.when(seen, is_so)), F.lit(False)) for name, is_so in type_tests(value).items()})


def column_profile(df: DataFrame, columns: list[str] | None = None, order: str | None = None, examples: int = 3) -> DataFrame:
    """(name, non_null, nulls, distinct, inferred_type, examples): blanks are nulls;
    examples are the first different values by ``order`` (by value without it).
    Distinct values are counted per value first, so no column's values meet in one task."""
    columns = columns or df.columns
    cells = long_form(df, columns, order)
    blank = trim(F.col("value")) == ""
    per_value = cells.groupBy("col_no", "name", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    live = F.when(~blank, F.col("value"))
    base = per_value.groupBy("col_no", "name").agg(
        F.coalesce(F.sum(F.when(~blank, F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(live).alias("distinct"), inferred_type(F.col("value")).alias("inferred_type"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("col_no").orderBy("first", "value"))
    some = per_value.where(~blank).withColumn("r", rank).where(F.col("r") <= examples).groupBy("col_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("examples"))
    return base.join(some, "col_no", "left").select("name", "non_null", "nulls", "distinct", "inferred_type", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def dataset_fingerprint(df: DataFrame, columns: list[str], order: list[str], delimiter: str = ",", rows: int = 20) -> DataFrame:
    """One row, fingerprint: 16 hex digits over headers, delimiter and the first rows."""
    line = F.concat_ws("|", *[text(F.col(f"`{c}`")) for c in columns])
    head = "|".join(re.sub(r"\s+", " ", c.strip()).lower() for c in columns) + delimiter
    first = df.select(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], line.alias("_line")).orderBy(*[f"_o{i}" for i in range(len(order))], "_line").limit(rows)
    keys = [f"_o{i}" for i in range(len(order))]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "_line"))), lambda s: s["_line"]), "")
    return first.agg(F.substring(F.sha1(F.concat(F.lit(head), joined).cast("binary")), 1, 16).alias("fingerprint"))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """(line): the first rows as "header=value, ..."."""
    parts = [F.concat(F.lit(c + "="), text(F.col(f"`{c}`"))) for c in df.columns]
    return df.limit(rows).select(F.concat_ws(", ", *parts).alias("line"))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, the same for the same seed and input order."""
    return df.orderBy(F.rand(seed)).limit(n)


def markdown_table(df: DataFrame, width: int = 120) -> DataFrame:
    """(line): rows as Markdown table lines, long cells cut with an ellipsis."""
    def cut(c: str) -> Column:
        t = F.replace(F.regexp_replace(text(F.col(f"`{c}`")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
        return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t)

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cut(c) for c in df.columns]), F.lit(" |")).alias("line"))
