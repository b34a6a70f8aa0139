from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.session import checkpoint, scratch_path, shared_root, spread


def fake(master, configured=None):
    folder = {"dir": None}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: folder["dir"], setCheckpointDir=lambda path: folder.update(dir=path))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context)


def test_the_session_names_the_shared_folder():
    assert shared_root(fake("yarn", "hdfs://shared/folder/")) == "hdfs://shared/folder"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        shared_root(fake("spark://host:7077"))


def test_local_mode_falls_back_once():
    session = fake("local[2]")
    assert shared_root(session) == shared_root(session)


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_checkpoint_keeps_rows(spark):
    df = spark.range(10).withColumn("p", F.spark_partition_id())
    fixed = checkpoint(df)
    assert fixed.count() == 10 and fixed.collect() == fixed.collect()


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(100).repartition(64)
    assert spread(wide) is wide
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
