"""Iterative graph work: frames written between rounds, and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Texts that go to Python at a time: what is made of them is many times as large.
BATCH_ROWS = 128


def text_batches(df: DataFrame) -> DataFrame:
    """The frame, after the session's Arrow batches were made small enough for whole
    texts: lowers their rows to BATCH_ROWS where there may be more. Results are
    computed later, so the setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it
    is unset, a local run gets a temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-graph-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def kept(df: DataFrame, tag: str, **measured: Column) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost
    executor costs nothing that was written. measured: aggregates by name, taken in
    the same job; ``.seen`` of the result has their values. What is not dropped
    before goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{tag}-{uuid.uuid4().hex}"
    watch = Observation() if measured else None
    (df.observe(watch, *[c.alias(n) for n, c in measured.items()]) if measured else df).write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to, out.seen = path, watch.get if measured else {}
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete kept frames that nothing reads any more."""
    for df in frames:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def numbered(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """(node_id, code) of the different nodes, written: code is a long that sorts as
    ``order`` does (by default node_id), so that rounds send numbers and no names."""
    by = order or ("node_id",)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = nodes.select("node_id").distinct().repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return kept(sorted_ids.select("node_id", F.monotonically_increasing_id().alias("code")), "codes")


def by_number(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) as codes, of the edges both of whose ends have one."""
    one = edges.select("src", "dst").join(codes.select(F.col("node_id").alias("src"), F.col("code").alias("s")), "src").select("s", "dst")
    return one.join(codes.select(F.col("node_id").alias("dst"), F.col("code").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node_id, component): component is the least id that a node is connected to,
    whatever the edges' direction. Isolated nodes are components of their own.

    Each round every node takes the least label about it, then the label's own
    label (pointer jumping), so long paths shrink by a factor a round. A round
    leaves one table behind, and deletes those of the round before.
    """
    both = edges.select("src", "dst").where("src <> dst")
    pairs = kept(both.unionAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    label = kept(nodes.select("node_id", F.col("node_id").alias("component")), "label")
    for _ in range(max_rounds):
        near = pairs.join(label.select(F.col("node_id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("least"))
        step = label.join(near.withColumnRenamed("src", "node_id"), "node_id", "left").select("node_id", "component", F.least("component", "least").alias("next"))
        step = kept(step, "step")
        up = step.select(F.col("node_id").alias("next"), F.col("next").alias("jump"))
        new = step.join(up, "next", "left").select("node_id", F.least("next", "jump").alias("component"), (F.col("component") != F.least("next", "jump")).alias("moved"))
        new = kept(new, "label", moved=F.count_if("moved"))
        dropped(label, step)
        label = new
        if not new.seen["moved"]:
            dropped(pairs)
            return label.select("node_id", "component")
    raise RuntimeError("components did not settle")
