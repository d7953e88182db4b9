from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sonaria.llm import common


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(spark, "x")
    spark.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(spark, "x")


def test_folders_are_released(spark):
    mark = common.made()
    a, b = (common.kept(spark.range(3), x) for x in "ab")
    common.release(spark, mark, but=1)
    assert common.made() == mark + 1 and b.count() == 3
    with pytest.raises(Exception):
        a.count()
    common.release(spark, mark)
    assert common.made() == mark


def test_buckets_follow_the_bytes(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab é "), 40).alias("text"))
    unknown = spark.createDataFrame([(1, "é" * 1000), (2, None)], "doc_id long, text string")  # no estimate: measured
    assert common.estimated(unknown) == 2000 and common.estimated(unknown.limit(0)) in (0, 2000)
    rows.write.parquet(f"file://{tmp_path}/t")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    size = common.estimated(docs)
    assert size > 0 and common.buckets(docs, size // 100) == 100 and common.buckets(docs) == common.partitions(spark)
    assert common.estimated(docs.join(docs.select("doc_id"), "doc_id")) == 2 * size  # no product of joined tables


def test_the_last_whole_version_of_a_file(spark, tmp_path):
    for k in range(12):
        common.write_text(spark, f"file://{tmp_path}/m", f"version {k}")
        assert common.read_text(spark, f"file://{tmp_path}/m") == f"version {k}"
    (tmp_path / "m" / ".00000099").write_text("broken off")
    assert common.read_text(spark, f"file://{tmp_path}/m") == "version 11"


def test_batches_stay_as_the_session_has_set_them(spark):
    old = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.set(common.BATCH, "1000")
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH) in ("1000", "1000b")
        spark.conf.unset(common.BATCH)
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH).rstrip("b") == str(8 << 20)
    finally:
        if old is None:
            spark.conf.unset(common.BATCH)
        else:
            spark.conf.set(common.BATCH, old)
