"""Value normalizers as Column expressions, by name.

All give "" for null, as cells of a text table do. Everything stays in the JVM but
title case, whose rule (a capital after anything that is no letter) has no
built-in.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words for true and false: fixed values.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
#: What counts as a number in text: digits with single underscores between, a fraction, an exponent.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

Transform = Callable[[Column], Column]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lower(c: Column) -> Column:
    return F.lower(trim(c))


def upper(c: Column) -> Column:
    return F.upper(trim(c))


@F.pandas_udf(StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.str.title()


def title_case(c: Column) -> Column:
    return _title(trim(c))


def slug(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.btrim(F.regexp_replace(lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def snake(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text(c), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def number(c: Column) -> Column:
    """A double, or null where the text is no plain decimal number."""
    t = trim(c)
    return F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def to_int(c: Column) -> Column:
    n = number(c)
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    return F.coalesce(F.when(F.abs(n) < 9.2e18, whole.try_cast("decimal(38,0)").cast("string")), F.lit(""))


def to_float(c: Column) -> Column:
    """The number as text, or "". Below 0.0001 and from 10 million on the exponent is written the JVM's way."""
    return F.coalesce(number(c).cast("string"), F.lit(""))


def to_bool(c: Column) -> Column:
    t = lower(c)
    return F.when(t.isin(*TRUE_WORDS), "true").when(t.isin(*FALSE_WORDS), "false").otherwise("")


def identity(c: Column) -> Column:
    return text(c)


REGISTRY: dict[str, Transform] = {
    "identity": identity, "trim": trim, "lower": lower, "upper": upper, "title_case": title_case,
    "slug": slug, "snake": snake, "to_int": to_int, "to_float": to_float, "to_bool": to_bool,
}


def register(name: str, transform: Transform) -> None:
    REGISTRY[name] = transform


def transform(name: str | None) -> Transform:
    """By name; unknown names leave the text as it is."""
    return REGISTRY.get(name or "identity", identity)
