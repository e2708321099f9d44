"""Structured Streaming jobs on the message stream: routing, trends, sessions, de-duplication, alerts, upserts.

Windows, sessions, de-duplication and the join carry a watermark, so their state is dropped once it can
no longer change; the running unread count keeps one row per project. Results go to files: append results through the exactly-once file sink, changing results as
one folder per batch, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Result retention and hard task limit, in seconds.
RETENTION_SECONDS = 3_600
TASK_LIMIT_SECONDS = 600
RETENTION = f"{RETENTION_SECONDS} seconds"
QUEUES = {"purchase": "analysis", "signup": "analysis", "view": "webhooks", "click": "webhooks"}
DEFAULT_QUEUE = "default"


def queue_of(kind: Column) -> Column:
    """Queue of a message by its type."""
    queue = F.lit(DEFAULT_QUEUE)
    for name, target in QUEUES.items():
        queue = F.when(kind == name, F.lit(target)).otherwise(queue)
    return queue


def routed(messages: DataFrame) -> DataFrame:
    """Messages with their queue; the sink splits by it in one pass."""
    return messages.withColumn("queue", queue_of(F.col("event_type")))


def windowed(messages: DataFrame, size: str, slide: str | None = None, late: str = RETENTION) -> DataFrame:
    """Mean and maximum value per type and window."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    risk = messages.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_risk"), F.max("value").alias("max_risk")
    )
    return risk.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "event_type", "n", "avg_risk", "max_risk",
    )


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = RETENTION) -> DataFrame:
    """Bursts of activity per project; sessions are merged before the shuffle."""
    found = messages.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return found.select(
        "user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total"
    )


def deduplicated(messages: DataFrame, late: str = RETENTION) -> DataFrame:
    """Each message once, however often it is delivered within the retention."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def unfinished(
    started: DataFrame, completed: DataFrame, limit_seconds: int = TASK_LIMIT_SECONDS, late: str = RETENTION
) -> DataFrame:
    """Started messages with their completions within the limit; a null completion is a stuck scan.

    Time is cut into buckets of the limit's length. A completion can only answer a start of its own
    bucket or the one before, so it is sent to both and the join keys are (project, bucket): a busy
    project is spread over its buckets, and every start still meets all its candidates in one place.
    """
    seconds = F.unix_timestamp("ts")
    left = started.withWatermark("ts", late).select(
        F.col("event_id").alias("started_id"),
        F.col("user_id").alias("s_user"),
        F.col("ts").alias("started_at"),
        F.floor(seconds / limit_seconds).alias("s_bucket"),
    )
    own = F.floor(seconds / limit_seconds)
    right = completed.withWatermark("ts", late).select(
        F.col("event_id").alias("completed_id"),
        F.col("user_id").alias("c_user"),
        F.col("ts").alias("completed_at"),
        F.explode(F.array(own - 1, own)).alias("c_bucket"),
    )
    within = F.expr(
        f"s_user = c_user AND s_bucket = c_bucket AND completed_at >= started_at "
        f"AND completed_at <= started_at + INTERVAL {limit_seconds} SECONDS"
    )
    joined = left.join(right, within, "left_outer")
    return joined.select("started_id", F.col("s_user").alias("user_id"), "started_at", "completed_id", "completed_at")


def first_completions(pairs: DataFrame) -> DataFrame:
    """Each start of stored pairs once, with its first completion or none; rows of heartbeats have no start and go."""
    answered = F.when(F.col("completed_id").isNotNull(), F.struct("completed_at", "completed_id"))
    first = F.min(answered).alias("_c")
    grouped = pairs.where("started_id is not null").groupBy("started_id", "user_id", "started_at").agg(first)
    return grouped.select("started_id", "user_id", "started_at", "_c.completed_id", "_c.completed_at")


def unread_counts(messages: DataFrame) -> DataFrame:
    """Running unread count per project (view and click count as read)."""
    read = F.col("event_type").isin("view", "click")
    return messages.groupBy("user_id").agg(
        F.count_if(~read).alias("unread_count"), F.count(F.lit(1)).alias("total_count"), F.max("ts").alias("newest_at")
    )


def append_to(results: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Start an append job into a parquet folder (exactly once), over all data there is."""
    writer = results.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions_to(
    results: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Start a job that writes every batch's changed rows as version folder ``batch_id=<n>``.

    A batch that is run again after a failure overwrites its own folder, so each takes effect once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = results.writeStream.outputMode(mode).foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path)


def newest_versions(
    spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Current state: each key's row that is last by the ``order`` columns (event order), then by batch."""
    stored = _versions(spark, path, schema)
    values = [c for c in stored.columns if c not in keys and c != "batch_id"]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order, "batch_id")).alias("_v"))
    return newest.select(*keys, "_v.*")


def newest_groups(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """All rows of every key's newest batch: a batch replaces everything a key had before."""
    stored = _versions(spark, path, schema)
    last = stored.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return stored.join(last, [key, "batch_id"]).drop("batch_id")


def compact(current: DataFrame, source: str, target: str) -> None:
    """Write the current state as the only version below ``target``, numbered as the newest one below ``source``.

    Readers move on to ``target``; jobs go on appending there, and ``source`` can be dropped.
    """
    spark = current.sparkSession
    last = spark.read.parquet(source).agg(F.max("batch_id")).first()[0]
    current.write.mode("overwrite").parquet(f"{target}/batch_id={last}")


def latest_in_batch(key: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """Reduce a batch to the last row of every key, by a combinable maximum."""

    def reduce_batch(batch: DataFrame) -> DataFrame:
        values = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v"))
        return last.select(key, "_v.*")

    return reduce_batch
