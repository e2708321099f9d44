"""Work folders and settings."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from riskloom import session


def fake(master, folder=None, configured=None):
    context = SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: configured or default))


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.checkpoint_root(fake("spark://host:7077"))


def test_the_named_folder_is_used():
    assert session.checkpoint_root(fake("yarn", configured="hdfs://shared/cp")) == "hdfs://shared/cp"
    assert session.checkpoint_root(fake("yarn", folder="hdfs://set/before", configured="hdfs://other")) == "hdfs://set/before"


def test_settled_rows_have_no_lineage(spark):
    settled = session.settle(spark.range(10).selectExpr("id * 2 AS x"))
    assert settled.count() == 10 and "Range" not in settled._jdf.queryExecution().toString()


def test_spread_only_when_splits_are_few(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=64)
    assert session.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(many, "id") is many
