"""Tables on Parquet without MERGE, safe for many writers.

A table's content is what its newest commit record lists: for each table the files'
folders by bucket. Data are written to new folders first; then the record is made
under the next number, which only one writer can do. Who comes second starts again
from the new state, so nothing is lost; who fails half way leaves folders that no
record lists. Tables of one ``TableSet`` change together: a reader sees all of a
commit or nothing of it.

Files of versions that are gone are deleted only when they are older than GRACE, so
that what is being read or written stays.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.query import Options, query
from weftline.operators.store import delete_document, insert_missing, upsert

#: Seconds; longer than any read or write of a table takes.
GRACE = 24 * 3600
BUCKETS = 64


class Lost(RuntimeError):
    """Other writers were faster each time."""


class CommitLog:
    """Records by number in a folder, each made by one writer only. The next record is
    written aside and then moved to its name: on a local disk by a link, which fails
    if the name exists, elsewhere by the file system's rename, which on HDFS does. A
    store whose rename writes over what is there does not give this."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def numbers(self) -> list[int]:
        top = self.path(self.folder)
        if not self.fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, n: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/{n:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """The last number and its record; 0 and nothing if there is none. A record
        that goes between listing and reading was not the newest."""
        while True:
            found = self.numbers()
            if not found:
                return 0, {}
            try:
                return found[-1], self.read(found[-1])
            except Exception:
                if found[-1] in self.numbers():
                    raise

    def claim(self, n: int, record: dict) -> bool:
        """Make record n; False if there is one already."""
        aside, to = f"{self.folder}/.{uuid.uuid4().hex}", f"{self.folder}/{n:012d}.json"
        out = self.fs.create(self.path(aside), False)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(self.path(aside), self.path(to)))
            try:
                os.link(*(self.path(p).toUri().getPath() for p in (aside, to)))
                return True
            except FileExistsError:
                return False
        finally:
            self.fs.delete(self.path(aside), False)

    def remove(self, n: int) -> None:
        self.fs.delete(self.path(f"{self.folder}/{n:012d}.json"), False)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class TableSet:
    """Tables under <folder>/data that change together, by records in <folder>/_commits."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, attempts: int = 20):
        self.spark, self.folder, self.buckets, self.attempts = spark, folder, buckets, attempts
        self.log = CommitLog(spark, f"{folder}/_commits")

    # -- reading

    def versions(self) -> list[int]:
        return self.log.numbers()

    def record(self, version: int | None = None) -> dict:
        return (self.log.newest()[1] if version is None else self.log.read(version)).get("tables", {})

    def frame(self, entry: dict, only: set[str] | None = None) -> DataFrame:
        """A table of a record, or some buckets of it: one scan, whatever it was made of."""
        schema = T.StructType.fromJson(entry["schema"])
        paths = sorted({p for b, p in entry["parts"].items() if only is None or b in only})
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema)
        if entry.get("partition_by"):
            found = found.option("basePath", f"{self.folder}/{paths[0]}")
        return found.parquet(*[f"{self.folder}/{p}" for p in paths])

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as of one commit."""
        return {name: self.frame(entry) for name, entry in self.record(version).items()}

    # -- writing

    def written(self, df: DataFrame, partition_by: tuple[str, ...] = (), keys: list[str] | None = None) -> dict:
        """Data in a new folder; the entry that lists it. keys: by bucket of these."""
        at = f"data/{uuid.uuid4().hex}"
        entry = {"schema": json.loads(df.schema.json()), "keys": keys, "partition_by": list(partition_by)}
        if keys is None:
            w = df.write.partitionBy(*partition_by) if partition_by else df.write
            w.parquet(f"{self.folder}/{at}")
            return entry | {"parts": {"all": at}}
        placed = df.withColumn("_bucket", bucket_of(keys, self.buckets))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{at}")
        found = [s.getPath().getName() for s in self.log.fs.listStatus(self.log.path(f"{self.folder}/{at}")) if s.isDirectory()]
        return entry | {"buckets": self.buckets, "parts": {name.split("=")[1]: f"{at}/{name}" for name in found if name.startswith("_bucket=")}}

    def upserted(self, entry: dict | None, rows: DataFrame, keys: list[str], order: str | None = None) -> dict:
        """The entry of a table with rows put in by their keys. Where the table lies by
        buckets of these keys, only the buckets that rows fall into are read and written."""
        if entry is None or entry.get("keys") != keys or entry.get("buckets") != self.buckets:
            return self.written(upsert(rows.limit(0) if entry is None else self.frame(entry), rows, keys, order), keys=keys)
        touched = {str(r[0]) for r in rows.select(bucket_of(keys, self.buckets)).distinct().collect()}  # a number for each bucket
        new = self.written(upsert(self.frame(entry, touched), rows, keys, order), keys=keys)
        return new | {"parts": {b: p for b, p in entry["parts"].items() if b not in touched} | new["parts"]}

    def commit(self, make: Callable[[dict], dict], keep: int = 2) -> int:
        """Entries for some tables, made from a record's, become the next version with
        all others as they are. If another writer was first, they are made again from
        its version; what the loser wrote is no part of any version."""
        for _ in range(self.attempts):
            n, record = self.log.newest()
            tables = record.get("tables", {})
            made = make(tables)
            if made == {}:
                return n
            if self.log.claim(n + 1, {"tables": {k: v for k, v in (tables | made).items() if v is not None}}):
                self.cleaned(keep)
                return n + 1
        raise Lost(f"{self.folder}: lost {self.attempts} times to other writers")

    def write(self, frames: dict[str, DataFrame], keep: int = 2, partition_by: tuple[str, ...] = ()) -> int:
        """Replace whole tables."""
        entries = {name: self.written(df, partition_by) for name, df in frames.items()}
        return self.commit(lambda _: entries, keep)

    def upsert(self, rows: dict[str, tuple[DataFrame, list[str]]], order: str | None = None, keep: int = 2) -> int:
        """Put rows into several tables by their keys, in one commit."""
        return self.commit(lambda tables: {name: self.upserted(tables.get(name), df, keys, order) for name, (df, keys) in rows.items()}, keep)

    def change(self, f: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], keep: int = 2) -> int:
        """Tables as a function of the tables there are; it runs again if another
        writer commits meanwhile, so it must be one that can."""
        return self.commit(lambda tables: {name: self.written(df) for name, df in f({k: self.frame(v) for k, v in tables.items()}).items()}, keep)

    def cleaned(self, keep: int, grace: float | None = None) -> None:
        """Forget all but the last ``keep`` versions; delete folders that none lists
        and that are older than ``grace`` seconds."""
        numbers = self.log.numbers()
        for n in numbers[:-keep]:
            self.log.remove(n)
        top = self.log.path(f"{self.folder}/data")
        old = time.time() - (GRACE if grace is None else grace)
        aged = [s.getPath() for s in self.log.fs.listStatus(top) if s.getModificationTime() / 1000 < old] if self.log.fs.exists(top) else []
        if not aged:
            return
        used = {p.split("/")[1] for n in self.log.numbers() for e in self.record(n).values() for p in e["parts"].values()}
        for p in aged:
            if p.getName() not in used:
                self.log.fs.delete(p, True)


class VersionedTable:
    """One table of its own."""

    def __init__(self, spark: SparkSession, folder: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.partition_by = spark, folder, partition_by
        self.tables = TableSet(spark, folder)

    def versions(self) -> list[int]:
        return self.tables.versions()

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.tables.record(version).get("rows")
        return None if found is None else self.tables.frame(found)

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """A new version; those before the last ``keep`` go."""
        return self.tables.write({"rows": df}, keep, self.partition_by)

    def upsert(self, new: DataFrame, keys: list[str], order: str | None = None) -> int:
        if self.partition_by:
            return self.tables.commit(lambda t: {"rows": self.tables.written(upsert(self.tables.frame(t["rows"]) if t else new.limit(0), new, keys, order), self.partition_by)})
        return self.tables.upsert({"rows": (new, keys)}, order)

    def delete_document(self, document_id: str) -> int | None:
        return self.delete(lambda df: delete_document({"t": df}, document_id)["t"])

    def delete(self, kept: Callable[[DataFrame], DataFrame]) -> int | None:
        """A version with the rows that ``kept`` gives; None if there is no table."""
        n = self.tables.commit(lambda t: {"rows": self.tables.written(kept(self.tables.frame(t["rows"])), self.partition_by, None if self.partition_by else t["rows"]["keys"])} if t else {})
        return n or None


class AppendedTable:
    """A table that only grows: rows lie by a hash of their key, a batch is compared
    with the buckets it touches only, and of rows with a known key none is added.
    Batches of one size are made into a larger one when there are MERGE of them, so
    that a table has few folders however many batches came, and a row is written
    again as often only as the number of batches has digits to that base."""

    MERGE = 16

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.tables = TableSet(spark, folder)

    def batches(self) -> list[str]:
        return [b["path"] for b in self._listed(self.tables.record())]

    @staticmethod
    def _listed(tables: dict) -> list[dict]:
        return tables.get("rows", {}).get("batches", [])

    def _stored(self, tables: dict) -> DataFrame | None:
        """One scan over all batches, with the column ``bucket`` to prune by."""
        paths = [b["path"] for b in self._listed(tables)]
        if not paths:
            return None
        schema = T.StructType.fromJson(tables["rows"]["schema"]).add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/{p}" for p in paths])

    def read(self) -> DataFrame | None:
        tables = self.tables.record()
        if "rows" not in tables:
            return None
        found = self._stored(tables)
        return self.spark.createDataFrame([], T.StructType.fromJson(tables["rows"]["schema"])) if found is None else found.drop("bucket", "batch")

    def _batch(self, rows: DataFrame, level: int) -> list[dict]:
        """A batch that was written, or none if it has no row."""
        at = f"data/batch={uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
        full = any(s.isDirectory() for s in self.tables.log.fs.listStatus(self.tables.log.path(f"{self.folder}/{at}")))
        return [{"path": at, "level": level}] if full else []

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose key is new, each key once; the version after it."""
        rows = rows.dropDuplicates([self.key]).withColumn("bucket", bucket_of([self.key], BUCKETS))

        def make(tables: dict) -> dict:
            old, new = self._stored(tables), rows
            if old is not None:
                touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
                new = insert_missing(rows.limit(0), rows.join(old.where(F.col("bucket").isin(touched)).select(self.key), self.key, "left_anti"), [self.key])
            schema = rows.drop("bucket").schema if old is None else insert_missing(old.drop("bucket", "batch").limit(0), rows.drop("bucket").limit(0), [self.key]).schema
            listed = self._listed(tables) + self._batch(new, 0)
            level = max((b["level"] for b in listed if sum(x["level"] == b["level"] for x in listed) >= self.MERGE), default=None)
            if level is not None:
                merged = [b for b in listed if b["level"] == level]
                some = {"rows": {"schema": json.loads(schema.json()), "batches": merged}}
                listed = [b for b in listed if b["level"] != level] + self._batch(self._stored(some).drop("batch"), level + 1)
            return {"rows": {"schema": json.loads(schema.json()), "batches": listed, "parts": {b["path"]: b["path"] for b in listed}}}

        return self.tables.commit(make)


class KeyedStore:
    """Rows kept by type and id: get, save, delete, exists, list and count. A type is
    a versioned table of its own; saving replaces the rows with the same ids."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder, key

    def table(self, kind: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{kind}")

    def save(self, kind: str, rows: DataFrame, order: str | None = None) -> int:
        return self.table(kind).upsert(rows, [self.key], order)

    def all(self, kind: str, options: Options | None = None) -> DataFrame | None:
        found = self.table(kind).read()
        return found if found is None or options is None else query(found, options, self.key)

    def get(self, kind: str, key) -> DataFrame | None:
        found = self.table(kind).read()
        return None if found is None else found.where(F.col(self.key) == key)

    def exists(self, kind: str, key) -> bool:
        found = self.get(kind, key)
        return found is not None and not found.isEmpty()

    def count(self, kind: str, options: Options | None = None) -> int:
        found = self.all(kind, options)
        return 0 if found is None else found.count()

    def delete(self, kind: str, key) -> bool:
        """True if there was such a row; without one nothing is written."""
        if not self.exists(kind, key):
            return False
        self.table(kind).delete(lambda df: df.where(~(F.col(self.key).eqNullSafe(F.lit(key)))))
        return True


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> list[str]:
    """Make the tables that are not there yet, empty; their names."""
    made = []
    for name, schema in schemas.items():
        t = VersionedTable(spark, f"{folder}/{name}")
        if not t.versions():
            t.write(spark.createDataFrame([], schema))
            made.append(name)
    return made


def drop_tables(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Delete tables with all their versions; the names of those that were there."""
    gone = []
    for name in names:
        log = VersionedTable(spark, f"{folder}/{name}").tables.log
        if log.fs.delete(log.path(f"{folder}/{name}"), True):
            gone.append(name)
    return gone
