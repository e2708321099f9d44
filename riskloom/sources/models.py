"""Schemas of the stored records: users, organisations, projects, scans, findings, notifications, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import configure

# Field names and status words of the records.
FINDING_STATUSES = ("open", "fixed", "false_positive", "accepted")
BASELINE_STATUSES = ("IMPROVED", "STABLE", "DEGRADED", "FRACTURED")
SCAN_STATUSES = ("pending", "running", "completed", "failed")

RECORDS = {
    "users": "id STRING, username STRING, email STRING, name STRING, avatar_url STRING, role STRING",
    "organizations": "id STRING, name STRING, slug STRING, plan STRING, member_count BIGINT",
    "projects": (
        "id STRING, name STRING, slug STRING, description STRING, github_repo STRING, risk_score DOUBLE, "
        "last_scan_at TIMESTAMP, findings_count BIGINT, scans_count BIGINT, baseline_status STRING"
    ),
    "scans": (
        "id STRING, project_id STRING, status STRING, commit_sha STRING, branch STRING, risk_score DOUBLE, "
        "risk_vector_90d MAP<STRING, DOUBLE>, findings_count BIGINT, critical_count BIGINT, high_count BIGINT, "
        "medium_count BIGINT, low_count BIGINT, info_count BIGINT, baseline_status STRING, triggered_by STRING, "
        "started_at TIMESTAMP, completed_at TIMESTAMP, created_at TIMESTAMP"
    ),
    "findings": (
        "id STRING, scan_id STRING, project_id STRING, rule_id STRING, title STRING, description STRING, "
        "severity STRING, confidence STRING, category STRING, file_path STRING, line_start INT, line_end INT, "
        "code_snippet STRING, remediation STRING, cwe_ids ARRAY<STRING>, status STRING, created_at TIMESTAMP"
    ),
    "notifications": "id STRING, title STRING, message STRING, read BOOLEAN, created_at TIMESTAMP",
    "reports": (
        "file_path STRING, unified_risk_score DOUBLE, risk_tier STRING, fusion_weights ARRAY<DOUBLE>, "
        "per_function_metrics ARRAY<STRUCT<function_key: STRING, mahalanobis_distance: DOUBLE, "
        "renyi_entropy_discrete: DOUBLE, renyi_entropy_differential: DOUBLE, renyi_z_score: DOUBLE, "
        "anomaly_score: DOUBLE, raw_feature_vector: ARRAY<DOUBLE>>>, "
        "security_findings ARRAY<STRUCT<severity: STRING, line_number: INT, category: STRING, node_path: STRING, "
        "confidence_score: DOUBLE>>, "
        "vectors STRUCT<aggregate_56d: ARRAY<DOUBLE>, anomaly_16d: ARRAY<DOUBLE>, threat_18d: ARRAY<DOUBLE>>"
    ),
}


def read_records(spark: SparkSession, path: str, name: str, multiline: bool = False) -> DataFrame:
    """JSON records with their fixed schema; ``multiline`` for pretty-printed files of one record."""
    reader = configure(spark).read.schema(RECORDS[name])
    return reader.option("multiLine", str(multiline).lower()).json(path)


def report_findings(reports: DataFrame) -> DataFrame:
    """One row per finding of every report."""
    return reports.selectExpr("file_path", "inline(security_findings)")


def report_functions(reports: DataFrame) -> DataFrame:
    """One row per function metric of every report."""
    return reports.selectExpr("file_path", "inline(per_function_metrics)")
