"""Queries of schemas: what a task holds."""

from pyspark.sql import functions as F

from weftline import schema_queries

SF = "/root/testdata/sf0.001"


def test_main_entities_are_counted_in_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(schema_queries, "ROWS_A_TASK", 100)
    got = schema_queries.main_entities(spark, SF)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    held = got.where("way = 'first header'").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > n / 200 and max(r["count"] for r in held) < 250
    assert got.groupBy("way").agg(F.sum("n")).where(F.col("sum(n)") == n).count() == 4
