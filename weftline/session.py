"""A SparkSession with the settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew joins; on a cluster leave ``master`` to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
