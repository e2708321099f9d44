"""Aggregations over findings, scans and projects. Facts are counted before they are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.levels import SEVERITIES, risk_tier


def severity_histogram(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """Findings per severity with the grand total; a missing severity counts as LOW."""
    counts = findings.groupBy(F.coalesce(F.col(severity), F.lit("LOW")).alias("severity")).agg(
        F.count(F.lit(1)).alias("findings")
    )
    # one row per severity: the window below sees a handful of rows
    total = F.sum("findings").over(Window.partitionBy())
    return counts.select("severity", "findings", total.alias("total_findings"))


def severity_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per severity plus ``findings_count``, per key."""
    per_level = [F.count_if(F.col("severity") == name).alias(f"{name}_count") for name in SEVERITIES]
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings_count"), *per_level)


COUNT_COLUMNS = ["findings_count", *[f"{name}_count" for name in SEVERITIES]]


def scan_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity counts of every scan, zeros for scans without findings."""
    counts = severity_counts(findings, ["scan_id"])
    return scans.join(counts, "scan_id", "left").na.fill(0, COUNT_COLUMNS)


def severity_pills(counted: DataFrame) -> DataFrame:
    """Counts per severity plus the row ``all``, from ``(severity, n)`` partial counts."""
    rolled = counted.rollup("severity").agg(F.sum("n").alias("n"), F.grouping("severity").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("severity")).alias("pill"), "n")


def mean_risk(results: DataFrame, keys: Sequence[str], score: str, critical: float = 0.7) -> DataFrame:
    """Mean score per key (0.0 without results) and its tier."""
    means = results.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_risk"))
    return means.withColumn("risk_tier", risk_tier(F.col("mean_risk"), critical))


def valid_results(results: DataFrame) -> DataFrame:
    """Results without ERROR rows; a null tier stays."""
    return results.where(F.col("risk_tier").isNull() | (F.col("risk_tier") != "ERROR"))


def corpus_summary(results: DataFrame) -> DataFrame:
    """One row over all valid per-file results; no row when there are none."""
    summary = valid_results(results).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.avg("risk_score").alias("mean_risk_score"),
        F.avg("security_findings_count").alias("mean_security_findings"),
        F.avg("structural_anomalies_count").alias("mean_structural_anomalies"),
        F.try_divide(F.count_if(F.col("risk_tier") == "CRITICAL") * 100, F.count(F.lit(1))).alias("critical_pct"),
        F.try_divide(
            F.count_if(F.col("structural_anomalies_count") > 0) * 100, F.count(F.lit(1))
        ).alias("anomalies_pct"),
    )
    return summary.where("total_files > 0")


def project_rollup(projects: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding count, scan count, last scan time and its status of every project."""
    per_scan = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    latest = F.struct("created_at", "scan_id")
    per_project = (
        scans.join(per_scan, "scan_id", "left")
        .groupBy("project_id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("findings_count"),
            F.count(F.lit(1)).alias("scans_count"),
            F.max("created_at").alias("last_scan_at"),
            F.max_by("status", latest).alias("last_status"),
        )
    )
    return projects.join(per_project, "project_id", "left").na.fill(0, ["findings_count", "scans_count"])


def dashboard_stats(projects: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Totals of the dashboard as one row."""
    project_totals = projects.agg(F.count(F.lit(1)).alias("total_projects"))
    scan_totals = scans.agg(
        F.count(F.lit(1)).alias("total_scans"), F.avg("risk_score").alias("avg_risk_score")
    )
    finding_totals = severity_counts(findings, []).withColumnRenamed("findings_count", "total_findings")
    parts = project_totals.unionByName(scan_totals, allowMissingColumns=True)
    parts = parts.unionByName(finding_totals, allowMissingColumns=True)
    # each column is set in exactly one of the three rows
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def latest_scan(scans: DataFrame) -> DataFrame:
    """Latest scan of every project (ties by scan id) by a combinable maximum, not by sorting groups."""
    row = F.struct("created_at", "scan_id", "status", "risk_score")
    return scans.groupBy("project_id").agg(F.max(row).alias("s")).select("project_id", "s.*")


def unread(notifications: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unread and total notifications per key, with the newest moment."""
    return notifications.groupBy(*keys).agg(
        F.count_if(~F.col("read")).alias("unread_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.max("created_at").alias("newest_at"),
    )


def distinct_contents(files: DataFrame, key: str, text: str) -> DataFrame:
    """Exact duplicates collapsed: lowest id and copy count per content."""
    return files.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(
        F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
