"""What the operators of this subpackage share: the shared folder, written
intermediate tables, session settings and a distributed component search."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches between the JVM and Python hold so many rows at most: texts may be long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole texts small enough for a Python worker: lowers
    the session's batch size to BATCH_ROWS where it is higher. Results are computed
    later, so the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's
    ``spark.checkpoint.dir``. Only where that is unset in a local run, as in tests,
    a temporary folder is set in its place; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor. What is not discarded before goes when the
    application ends."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def grouped(run, rows: int = 10_000):
    """For mapInArrow: what ``run`` gives, in batches of ``rows`` or more."""

    def joined(batches):
        held, n = [], 0
        for b in run(batches):
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str):
    """A text column's UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, root), root the
    smallest node of the component, for every node that has an edge to another.

    Large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"), until every component is a star about its smallest node.
    Each round writes its edges to the shared folder; only one number a round, of
    nodes that are not yet so, comes to the driver. The least neighbour of each node is written too, so that the join back has an
    exchange on either side and adaptive execution can split a hub's rows.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: (u, v), u > v. Large: around each node, all neighbours; small: the smaller ones only.
        around = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select("u", "v")
        least = written(around.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m")), "least")
        met = around.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        out = written(out.where("u <> v").distinct(), "star")
        discard(least, e)
        return out

    def astray(e: DataFrame) -> int:
        """Nodes with several smaller neighbours, or with a smaller and a larger one."""
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("x")).select("x.*")
        met = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return met.where("below > 1 or below = 1 and above = 1").count()

    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if not astray(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = star(star(e, True), False)
    raise RuntimeError("components did not settle")
