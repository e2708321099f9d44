"""Baseline snapshots: saved per project, the newest version of a project wins.

A save appends a version folder sorted by id, so it costs what is saved and never rewrites other projects; saving the same
version again replaces it. File statistics let a load of one project skip all files and row groups but its own. ``compact``
writes the current state as one version. Function profiles stay rows ``(safe_id, function_key, ...)`` beside the project
row: a project of any size never becomes one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import safe_id
from riskloom.operators.fusion import ANOMALY_WIDTH, POOLED_WIDTH, THREAT_WIDTH, vector_or_zeros
from riskloom.session import configure

def save(rows: DataFrame, path: str, version: int, project: str = "project_id") -> None:
    """Save rows of projects as ``version``; safe to repeat."""
    identity = safe_id(F.col(project).cast("string"))
    tagged = rows.withColumn("safe_id", identity).withColumn("version", F.lit(version).cast("bigint"))
    # ranges of ids, so that a file's statistics say which projects it can hold
    sorted_rows = tagged.repartitionByRange("safe_id").sortWithinPartitions("safe_id")
    sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return configure(spark).read.schema(f"{schema}, safe_id STRING, version BIGINT").parquet(path)


def _newest(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in stored.columns if c not in (*keys, "version")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_v"))
    return newest.select(*keys, "_v.*")


def load_all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newest row of every saved project."""
    return _newest(_stored(spark, path, schema), ["safe_id"])


def load(spark: SparkSession, path: str, schema: str, project_id: str) -> DataFrame:
    """Newest row of one project; an unknown project is an error."""
    identity = safe_id(F.lit(project_id))
    found = _newest(_stored(spark, path, schema).where(F.col("safe_id") == identity), ["safe_id"])
    if found.isEmpty():
        raise FileNotFoundError(f"no baseline for project {project_id!r} in {path}")
    return found


def load_functions(spark: SparkSession, path: str, schema: str, projects: str) -> DataFrame:
    """Function rows of every project's newest version.

    ``projects`` is where the project rows were saved: a project saved without functions has none, whatever it had before.
    """
    versions = _stored(spark, projects, "project_id STRING").groupBy("safe_id").agg(F.max("version").alias("version"))
    return _stored(spark, path, schema).join(versions, ["safe_id", "version"]).drop("version")


def compact(spark: SparkSession, path: str, schema: str, target: str) -> None:
    """Write the newest row of every project as the only version below ``target``; ``path`` can be dropped then."""
    last = _stored(spark, path, schema).agg(F.max("version")).first()[0]
    if last is not None:
        save(load_all(spark, path, schema).drop("safe_id"), target, last)


def build(projects: DataFrame, security: DataFrame, vectors: DataFrame, risk: DataFrame) -> DataFrame:
    """Snapshot rows of projects from per-project parts; missing parts take their defaults.

    ``security (project_id, severity_counts, total_threats)``, ``vectors (project_id, aggregate_56d,
    anomaly_16d, threat_18d)`` and ``risk (project_id, unified_risk_score, risk_tier)``.
    """
    joined = projects.select("project_id")
    for part in (security, vectors, risk):
        joined = joined.join(part, "project_id", "left")
    no_counts = F.create_map().cast("map<string,bigint>")
    return joined.select(
        "project_id",
        F.struct(
            F.coalesce("severity_counts", no_counts).alias("severity_counts"),
            F.coalesce("total_threats", F.lit(0)).cast("bigint").alias("total_threats"),
        ).alias("security"),
        F.struct(
            vector_or_zeros(F.col("aggregate_56d"), POOLED_WIDTH).alias("aggregate_56d"),
            vector_or_zeros(F.col("anomaly_16d"), ANOMALY_WIDTH).alias("anomaly_16d"),
            vector_or_zeros(F.col("threat_18d"), THREAT_WIDTH).alias("threat_18d"),
        ).alias("vectors"),
        F.struct(
            F.coalesce("unified_risk_score", F.lit(0.0)).alias("unified_risk_score"),
            F.coalesce("risk_tier", F.lit("LOW")).alias("risk_tier"),
        ).alias("risk"),
    )


SNAPSHOT_SCHEMA = (
    "project_id BIGINT, security STRUCT<severity_counts: MAP<STRING, BIGINT>, total_threats: BIGINT>, "
    "vectors STRUCT<aggregate_56d: ARRAY<DOUBLE>, anomaly_16d: ARRAY<DOUBLE>, threat_18d: ARRAY<DOUBLE>>, "
    "risk STRUCT<unified_risk_score: DOUBLE, risk_tier: STRING>"
)


def risk_vector_map(vectors: Column) -> Column:
    """The 90 risk features (56 + 16 + 18) as a map of position to value."""
    values = F.concat(vectors["aggregate_56d"], vectors["anomaly_16d"], vectors["threat_18d"])
    width = POOLED_WIDTH + ANOMALY_WIDTH + THREAT_WIDTH
    names = F.array(*[F.lit(f"d{i}") for i in range(width)])
    return F.map_from_arrays(names, values)
