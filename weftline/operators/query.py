"""Filter, sort, page and count by declared options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Filter:
    """op: eq, ne, gt, gte, lt, lte, in or like. A field may be a dotted path."""

    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Options:
    filters: list[Filter] = field(default_factory=list)
    order_by: str | None = None
    descending: bool = False
    offset: int = 0
    limit: int | None = None


def condition(f: Filter, schema: T.StructType) -> Column:
    """Null meets nothing but "eq" with None; "ne" needs a value; "in" on an array
    is overlap; "like" is a substring without regard to case."""
    c = F.col(f.field)
    if f.value is None:
        if f.op == "eq":
            return c.isNull()
        return c.isNotNull() if f.op == "ne" else F.lit(False)
    if f.op == "in":
        values = list(f.value)
        kind = schema[f.field].dataType if f.field in schema.fieldNames() else None
        if not values:
            return F.lit(False)
        return F.arrays_overlap(c, F.array(*map(F.lit, values))) if isinstance(kind, T.ArrayType) else c.isin(*values)
    if f.op == "like":
        return F.contains(F.lower(c.cast("string")), F.lit(str(f.value).lower()))
    tests = {"eq": c.__eq__, "ne": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
    if f.op not in tests:
        raise ValueError(f"unknown operator {f.op!r}")
    return tests[f.op](F.lit(f.value))


def filtered(df: DataFrame, options: Options) -> DataFrame:
    for f in options.filters:
        df = df.where(F.coalesce(condition(f, df.schema), F.lit(False)))
    return df


def query(df: DataFrame, options: Options, tie: str | None = None) -> DataFrame:
    """Nulls sort last either way; ``tie`` orders equals."""
    df = filtered(df, options)
    if options.order_by:
        c = F.col(options.order_by)
        df = df.orderBy(c.desc_nulls_last() if options.descending else c.asc_nulls_last(), *([tie] if tie else []))
    if options.offset:
        df = df.offset(options.offset)
    return df if options.limit is None else df.limit(options.limit)


def count(df: DataFrame, options: Options) -> DataFrame:
    return filtered(df, options).agg(F.count("*").alias("n"))


def user_statistics(cards: DataFrame, now: Column) -> DataFrame:
    """Per user: cards, cards due, average ease, reviewed today."""
    return cards.groupBy("user_id").agg(
        F.count("*").alias("total_cards"), F.count_if(F.col("due_at") <= now).alias("cards_due"),
        F.avg("ease").alias("average_ease"), F.count_if(F.to_date("reviewed_at") == F.to_date(now)).alias("reviewed_today"))
