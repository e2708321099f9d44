"""Push to comment: per-file results stream in, a pull request is rated from all its files so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.levels import risk_tier
from riskloom.operators.drift import drift
from riskloom.operators.keyed import with_baseline
from riskloom.operators.reporting import markdown_comments
from riskloom.streaming.jobs import newest_groups


def review(
    results: DataFrame, baselines: DataFrame, key: str, order: Sequence[str] = ("file_path",)
) -> tuple[DataFrame, DataFrame]:
    """(ratings, comments) of the pull requests in ``results``.

    ``results (key, file_path, risk_score, risk_tier, findings_count)``; ``baselines (key, risk_before)``.
    A pull request without a baseline is rated but has no drift line. Only the change of risk is known
    for a push, so the other parts of the drift drop out.
    """
    rated = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("findings_count").alias("total_findings"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("risk_after"),
    )
    none = F.lit(None).cast("double")
    paired = with_baseline(rated, baselines, key).withColumn("risk_tier", risk_tier(F.col("risk_after")))
    scored = drift(paired.withColumn("key_distance", none).withColumn("vector_change", none))
    known = F.col("risk_before").isNotNull()
    ratings = scored.select(
        key, "files", "total_findings", F.col("risk_after").alias("mean_risk"), "risk_tier",
        F.when(known, F.col("drift_score")).alias("drift_score"), F.when(known, F.col("risk_trend")).alias("risk_trend"),
    )
    drifts = ratings.where("risk_trend is not null").select(
        key, F.col("risk_trend").alias("trend"), F.col("drift_score").alias("score")
    )
    return ratings, markdown_comments(results, drifts, key, [F.col(c) for c in order])


def review_job(
    results: DataFrame, baselines: DataFrame, key: str, folder: str, order: Sequence[str] = ("file_path",)
) -> StreamingQuery:
    """Start the job that keeps every pull request's comment up to date.

    File rows of all batches are kept below ``folder/files``. A batch re-rates the pull requests it touches from all
    their files (the newest row of each path) and writes their comments, as pieces with the ratings beside them, as a version
    below ``folder/comments``. A batch that runs again overwrites its own two folders.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/files/batch_id={batch_id}")
        stored = spark.read.schema(f"{schema}, batch_id BIGINT").parquet(f"{folder}/files").where(F.col("batch_id") <= batch_id)
        touched = stored.where(F.col("batch_id") == batch_id).select(key).distinct()
        values = [c for c in batch.columns if c not in (key, "file_path")]
        files = stored.join(touched, key, "left_semi").groupBy(key, "file_path")
        files = files.agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(key, "file_path", "_v.*")
        ratings, comments = review(files, baselines, key, order)
        # a pull request's pieces are the many side here; its rating is one row
        comments.join(ratings, key).write.mode("overwrite").parquet(f"{folder}/comments/batch_id={batch_id}")

    writer = results.writeStream.outputMode("append").foreachBatch(run)
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


COMMENT_SCHEMA = (
    "ordinal BIGINT, piece STRING, files BIGINT, total_findings BIGINT, mean_risk DOUBLE, risk_tier STRING, "
    "drift_score DOUBLE, risk_trend STRING"
)


def posted(spark: SparkSession, folder: str, key: str, key_type: str) -> DataFrame:
    """The comments as they stand: the newest version of each pull request, whole."""
    return newest_groups(spark, f"{folder}/comments", f"{key} {key_type}, {COMMENT_SCHEMA}", key)
