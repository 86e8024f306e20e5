"""Keys, functional and inclusion dependencies found in data: what an ontology needs
to name entities, their attributes and their relationships.

All three look for candidates with small mergeable sketches, one scan a table and
level, and then settle each survivor exactly. A sketch only ever rules out what it
is sure of within its error, so nothing that holds is lost:

* distinct counts by HyperLogLog rule out sets of columns with far fewer values than
  rows, and X -> A where X and X with A differ far in number;
* bottom-k sketches of values rule out that a column's values are among another's:
  any hash below the other's last that the other lacks is a proof.

Sets of columns grow level by level, and none is looked at that holds a key (or a
determinant) found before, so what is found is minimal. Columns and candidates are
plan-time lists; values never come to the driver but k hashes a column.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a sketch of distinct values, the relative standard deviation of its count (1.6 %, rounded up), and how many of these are allowed for.
LG_K, RSD, SURE = 12, 0.02, 5
SKETCH = 512


class Key(NamedTuple):
    table: str
    columns: tuple[str, ...]


class Functional(NamedTuple):
    table: str
    columns: tuple[str, ...]
    determines: str


class Inclusion(NamedTuple):
    table: str
    column: str
    of_table: str
    of_column: str
    coverage: float  # distinct values of the column over those of the other


def plain_columns(df: DataFrame, floats: bool = True) -> list[str]:
    """The columns that can be compared: no arrays, maps or structs."""
    out = (T.ArrayType, T.MapType, T.StructType) if floats else (T.ArrayType, T.MapType, T.StructType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema if not isinstance(f.dataType, out)]


def those(check, candidates: list) -> list:
    """The candidates that pass; a few are checked at a time, each by jobs of its own."""
    with ThreadPoolExecutor(8) as pool:
        return [c for c, ok in zip(candidates, pool.map(check, candidates)) if ok]


def value(columns: tuple[str, ...]) -> Column:
    """A hash of the columns' values in which nulls differ from all values."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def sizes(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many different values each set of columns has, in one scan."""
    out = {}
    for at in range(0, len(sets), 200):  # columns of one aggregate
        some = sets[at:at + 200]
        row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(value(s), LG_K)).alias(str(i)) for i, s in enumerate(some)]).head()
        out |= dict(zip(some, row))
    return out


def is_key(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """No null and no value twice."""
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    own = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], null.alias("null"))
    twice = own.groupBy(*own.columns[:-1]).agg(F.count("*").alias("n"), F.max(F.col("null")).alias("lacks"))
    return twice.where("n > 1 or lacks").isEmpty()


def keys(df: DataFrame, table: str = "", most: int = 2, columns: list[str] | None = None) -> list[Key]:
    """The minimal sets of up to ``most`` columns whose values are never null and
    never twice, by level; floats are in none, but where ``columns`` names them. A
    table without rows has none."""
    names = columns or plain_columns(df, floats=False)
    n = df.count()
    found: list[Key] = []
    if not n:
        return found
    for level in range(1, most + 1):
        sets = [s for s in itertools.combinations(names, level) if not any(set(k.columns) <= set(s) for k in found)]
        about = sizes(df, sets)
        likely = [s for s in sets if about[s] >= n * (1 - SURE * RSD)]
        found += [Key(table, s) for s in those(lambda s: is_key(df, s), likely)]
    return found


def determines(df: DataFrame, columns: tuple[str, ...], other: str) -> bool:
    """Rows equal in ``columns`` are equal in ``other``; nulls are equal to each other."""
    own = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], F.col(other).alias("v"))
    g = own.groupBy(*own.columns[:-1]).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"), F.count("*").alias("m"))
    return g.where("least <> most or (n > 0 and n < m)").isEmpty()


def functional(df: DataFrame, table: str = "", most: int = 1, columns: list[str] | None = None, known: list[Key] | None = None) -> list[Functional]:
    """Minimal X -> A with up to ``most`` columns in X. Sets that hold a key determine
    everything and are left out, as are columns of one value, which all determine."""
    names = columns or plain_columns(df)
    own = known if known is not None else keys(df, table, most, columns)
    one = sizes(df, [(c,) for c in names])
    fixed = {c for c in names if one[c,] <= 1 and df.select(c).distinct().limit(2).count() <= 1}
    found: list[Functional] = []
    for level in range(1, most + 1):
        sets = [s for s in itertools.combinations([c for c in names if c not in fixed], level) if not any(set(k.columns) <= set(s) for k in own)]
        pairs = [(s, a) for s in sets for a in names if a not in s and a not in fixed and not any(f.determines == a and set(f.columns) <= set(s) for f in found)]
        about = sizes(df, sorted({s for s, _ in pairs} | {(*s, a) for s, a in pairs}))
        likely = [(s, a) for s, a in pairs if about[*s, a] * (1 - SURE * RSD) <= about[s] * (1 + SURE * RSD)]
        found += [Functional(table, s, a) for s, a in those(lambda x: determines(df, *x), likely)]
    return found


def kind(t: T.DataType) -> str:
    return "whole" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else t.simpleString()


def sketches(df: DataFrame, columns: list[str], k: int) -> dict[str, list[int]]:
    """The k least hashes of each column's values, ascending. Tasks cut to k first."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))).alias("h")) for c in columns]))
    each = df.select(cells.alias("x")).select("x.*").where("h is not null").distinct()
    least = each.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("h"))).where(F.col("r") <= k)
    out: dict[str, list[int]] = {c: [] for c in columns}
    for r in least.collect():  # k hashes a column
        out[r.name].append(r.h)
    return {c: sorted(hs) for c, hs in out.items()}


def ruled_out(part: list[int], whole: list[int], k: int) -> bool:
    """Whether a value below what the other's sketch covers is missing in it."""
    last = whole[-1] if len(whole) == k else None
    seen = set(whole)
    return any(h not in seen for h in part if last is None or h <= last)


def inclusions(tables: dict[str, DataFrame], of: list[Key] | None = None, k: int = SKETCH) -> list[Inclusion]:
    """Columns all of whose values are values of a key of one column, of the same kind
    and another table or column. Columns without a value are left out."""
    targets = of if of is not None else [x for name, df in tables.items() for x in keys(df, name, 1)]
    targets = [t for t in targets if len(t.columns) == 1]
    sketch = {name: sketches(df, plain_columns(df), k) for name, df in tables.items()}
    types = {name: {f.name: kind(f.dataType) for f in df.schema} for name, df in tables.items()}
    rows = {t.table: tables[t.table].count() for t in targets}
    likely = [
        (name, c, t.table, t.columns[0]) for name, df in tables.items() for c in plain_columns(df) for t in targets
        if sketch[name][c] and (name, c) != (t.table, t.columns[0]) and types[name][c] == types[t.table][t.columns[0]] and not ruled_out(sketch[name][c], sketch[t.table][t.columns[0]], k)]
    share = {}

    def holds(x: tuple[str, str, str, str]) -> bool:
        name, c, of_name, to = x
        own = tables[name].where(F.col(c).isNotNull()).select(F.col(c).alias("v")).distinct()
        met = own.join(tables[of_name].select(F.col(to).alias("v"), F.lit(True).alias("there")), "v", "left")
        n, lacks = met.agg(F.count("*"), F.count_if(F.col("there").isNull())).head()
        share[x] = n / rows[of_name] if n else 0.0
        return not lacks

    return [Inclusion(*x, share[x]) for x in those(holds, likely)]


def ontology_of(tables: dict[str, DataFrame], most: int = 2) -> dict:
    """An ontology for ``plans.ontology``: an entity a table with its smallest key and
    its attributes, a relationship for each column whose values are another table's
    key; of several such keys the one it covers most of, then the first."""
    own = {name: keys(df, name, most) for name, df in tables.items()}
    links = inclusions(tables, [k for ks in own.values() for k in ks])
    best: dict[tuple[str, str], Inclusion] = {}
    for x in links:
        if x.table != x.of_table and (x.column,) not in [k.columns for k in own[x.table]]:
            at = (x.table, x.column)
            best[at] = min(best.get(at, x), x, key=lambda y: (-y.coverage, y.of_table, y.of_column))
    entities = []
    for name, df in tables.items():
        key = own[name][0].columns if own[name] else ()
        linked = {c for t, c in best if t == name}
        entities.append({"name": name, "primary_key": list(key), "attributes": [{"name": c} for c in plain_columns(df) if c not in key and c not in linked]})
    relationships = [{"predicate": f"has_{x.of_table}", "source": x.table, "target": x.of_table, "join_columns": {"source_col": x.column, "target_col": x.of_column}} for x in best.values()]
    return {"entities": entities, "relationships": relationships}
