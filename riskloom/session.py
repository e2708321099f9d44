"""Session settings and the shared work folder every job writes through."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import riskloom

# What results depend on: always applied.
REQUIRED_SETTINGS = {"spark.sql.session.timeZone": "UTC"}
# What plans gain from: applied unless the session says otherwise.
PREFERRED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of long texts: batches to Python are bounded in bytes, not only in rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
# Stream state beyond the memory of the executors; a local session has no use for it.
CLUSTER_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the jobs rely on (UTC clock, adaptive plans).

    Python functions of this package travel to the executors by value, so they need no installation there.
    """
    cloudpickle.register_pickle_by_value(riskloom)
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    preferred = dict(PREFERRED_SETTINGS)
    if not spark.sparkContext.master.startswith("local"):
        preferred |= CLUSTER_SETTINGS
    for key, value in preferred.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    On a cluster it must be named by ``spark.checkpoint.dir`` (or set on the context); only a local-mode session, where
    driver and executors share one disk, may fall back to a folder below the warehouse.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/riskloom-work"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/riskloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and go on from there (survives lost executors)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the scan yields fewer splits than cores; else leave as is.

    A table of many files already has enough splits, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])
