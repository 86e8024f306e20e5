from types import SimpleNamespace

import pytest

from weftline.llm import common


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    made = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        common.shared_dir(made)


def test_a_smaller_batch_size_stays(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", str(common.BATCH_ROWS)), ("64", "64"), ("0", str(common.BATCH_ROWS))):
            spark.conf.set(name, given)
            common.prepare(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_written_tables_can_be_discarded(spark):
    df = common.written(spark.range(10), "x")
    assert df.count() == 10
    common.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(df.written_to).count()
