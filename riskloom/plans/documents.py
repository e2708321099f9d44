"""Queries that write and read back: CSV results, snapshots, SARIF and JSON reports, Markdown, plug-in scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import levels, scanner
from riskloom.functions.levels import risk_tier
from riskloom.operators import reporting, rollups
from riskloom.plans import roles
from riskloom.plans.projects import SPLIT
from riskloom.plans.registry import query
from riskloom.plans.scoring import SQL_RESULTS, SUMMARY_SQL, corpus_results, rounded_summary
from riskloom.session import settle, shared_dir
from riskloom.sources import results as result_files
from riskloom.sources import snapshots
from riskloom.sources.tables import table


@query(
    "csv_roundtrip_summary",
    f"""WITH {SQL_RESULTS.replace('results AS (SELECT doc_id, source, risk_score,',
                                 "results AS (SELECT doc_id, source, CAST(printf('%.4f', risk_score) AS DOUBLE) AS risk_score,")
        } {SUMMARY_SQL}""",
)
def csv_roundtrip_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Every file's result, and an ERROR row for each file of the same tree that is no UTF-8; those leave the summary.

    Damaged copies of the pages stand for the unreadable files: their text cut inside a character.
    """
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path")
    rows = corpus_results(spark, folder).select("*", path)
    raw = F.concat(F.col("html").cast("binary"), F.unhex(F.lit("C3")))
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("damaged/"), F.col("page_id").cast("string")).alias("file_path"), raw.alias("content")
    )
    failed = pages.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("file_path")
    written = settle(result_files.with_errors(rows, failed))
    target = shared_dir(spark, "results-csv")
    result_files.write_csv(written, target)
    return rounded_summary(rollups.corpus_summary(result_files.read_csv(spark, target)))


def _snapshots(scans: DataFrame) -> DataFrame:
    projects = scans.select("project_id").distinct()
    per_level = scans.groupBy("project_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    security = per_level.groupBy("project_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"),
        F.sum("n").alias("total_threats"),
    )
    risk = scans.groupBy("project_id").agg(F.max("risk_score").alias("unified_risk_score"))
    risk = risk.withColumn("risk_tier", risk_tier(F.col("unified_risk_score")))
    threat = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: (i * F.col("total_threats")).cast("double"))
    none = F.lit(None).cast("array<double>")
    vectors = security.select("project_id", none.alias("aggregate_56d"), none.alias("anomaly_16d"),
                              threat.alias("threat_18d"))
    return snapshots.build(projects, security, vectors, risk)


_SNAPSHOT_LEVELS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in levels.SEVERITIES)


@query(
    "snapshot_roundtrip",
    f"""WITH {roles.SQL_SCANS}, versions AS (
      SELECT project_id, CASE WHEN created_at >= TIMESTAMP '{SPLIT}' THEN 2 ELSE 1 END AS v, count(*) AS total_threats,
        max(risk_score) AS risk_score, {_SNAPSHOT_LEVELS} FROM scans GROUP BY ALL),
    newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY v DESC) = 1)
    SELECT project_id, project_id::VARCHAR AS safe_id, total_threats, risk_score,
      {roles.SQL_TIER.format('risk_score')} AS risk_tier, {', '.join(f'{s}_count' for s in levels.SEVERITIES)},
      171 * total_threats::DOUBLE AS vector_sum, 90 AS vector_size FROM newest""",
)
def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    target = shared_dir(spark, "snapshots")
    snapshots.save(_snapshots(scans.where(F.col("created_at") < split)), target, 1)
    snapshots.save(_snapshots(scans.where(F.col("created_at") >= split)), target, 2)
    loaded = snapshots.load_all(spark, target, snapshots.SNAPSHOT_SCHEMA)
    features = snapshots.risk_vector_map(F.col("vectors"))
    counts = [
        F.coalesce(F.try_element_at("security.severity_counts", F.lit(s)), F.lit(0)).alias(f"{s}_count")
        for s in levels.SEVERITIES
    ]
    return loaded.withColumn("features", features).select(
        "project_id",
        "safe_id",
        "security.total_threats",
        F.col("risk.unified_risk_score").alias("risk_score"),
        "risk.risk_tier",
        *counts,
        F.aggregate(F.map_values("features"), F.lit(0.0), lambda s, x: s + x).alias("vector_sum"),
        F.size("features").alias("vector_size"),
    )


def _scan_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, results): scans, and their findings, anomalous functions and module rows."""
    scans = roles.scans(spark, folder)
    found = roles.findings(spark, folder).withColumn("severity", F.upper("severity"))
    security = reporting.security_results(found, "scan_id")
    key = F.concat(F.col("node_path"), F.lit("@"), F.col("line_number").cast("string"), F.lit(":x"))
    functions = found.select(
        "scan_id",
        key.alias("function_key"),
        (F.col("confidence_score") * 3).alias("renyi_z_score"),
        F.col("confidence_score").alias("mahalanobis_distance"),
    )
    modules = scans.select(
        "scan_id", (F.col("risk_score") * 2).alias("renyi_z_score"), F.col("risk_score").alias("mahalanobis_distance")
    )
    union = security.unionByName(reporting.function_results(functions, "scan_id"))
    return scans, union.unionByName(reporting.module_results(modules, "scan_id"))


_SQL_RESULT_ROWS = """result_rows AS (
  SELECT scan_id, 0 AS section, category AS rule, greatest(1, line_number) AS line,
    CASE upper(severity) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
      WHEN 'LOW' THEN 'note' ELSE 'warning' END AS level,
    category || ': ' || node_path || ' (confidence=' || printf('%.2f', confidence_score) || ')' AS message FROM findings
  UNION ALL
  SELECT scan_id, 1, 'structural-anomaly', line_number, 'warning', 'Structural anomaly in ' || node_path || '@'
    || line_number || ':x (Anomaly Z=' || printf('%.2f', confidence_score * 3) || ', Mahalanobis='
    || printf('%.2f', confidence_score) || ')' FROM findings WHERE NOT confidence_score * 3 < 1.5
  UNION ALL
  SELECT scan_id, 2, 'structural-anomaly', 1, 'warning', 'Module-level structural anomaly (Anomaly Z='
    || printf('%.2f', risk_score * 2) || ', Mahalanobis=' || printf('%.2f', risk_score) || ')'
  FROM scans WHERE risk_score * 2 >= 1.5)"""


@query(
    "sarif_documents",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, {_SQL_RESULT_ROWS},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY section, line, rule, level, message) AS i
      FROM result_rows),
    counts AS (SELECT scan_id, count(*) AS n FROM result_rows GROUP BY 1)
    SELECT scan_id, 1 AS ordinal, '{{"$schema":"{reporting.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'
      || '{{"name":"{reporting.TOOL_NAME}","version":"{reporting.TOOL_VERSION}"}}}},"results":[' AS piece FROM scans
    UNION ALL
    SELECT scan_id, i + 1, CASE WHEN i > 1 THEN ',' ELSE '' END || '{{"ruleId":"' || rule || '","level":"' || level
      || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"'
      || scan_id || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' FROM numbered
    UNION ALL
    SELECT scan_id, coalesce(n, 0) + 2, ']}}]}}' FROM scans LEFT JOIN counts USING (scan_id)""",
)
def sarif_documents(spark: SparkSession, folder: str) -> DataFrame:
    scans, results = _scan_results(spark, folder)
    order = [F.col(c) for c in ("line", "rule", "level", "message")]
    return reporting.sarif_documents(scans, results, "scan_id", order)


@query(
    "report_json",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, lists AS (
      SELECT scan_id, list(DISTINCT category ORDER BY category) AS categories, count(*) AS findings_count,
        max(confidence_score) AS max_confidence FROM findings GROUP BY 1)
    SELECT scan_id, to_json({{'file_path': 'scan/' || scan_id, 'unified_risk_score': risk_score,
      'risk_tier': {roles.SQL_TIER.format('risk_score')}, 'categories': coalesce(categories, []),
      'findings_count': coalesce(findings_count, 0), 'max_confidence': max_confidence}})::VARCHAR AS report
    FROM scans LEFT JOIN lists USING (scan_id)""",
)
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    lists = roles.findings(spark, folder).groupBy("scan_id").agg(
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.count(F.lit(1)).alias("findings_count"),
        F.max("confidence_score").alias("max_confidence"),
    )
    reports = roles.scans(spark, folder).join(lists, "scan_id", "left").select(
        "scan_id",
        F.concat(F.lit("scan/"), F.col("scan_id").cast("string")).alias("file_path"),
        F.col("risk_score").alias("unified_risk_score"),
        risk_tier(F.col("risk_score")).alias("risk_tier"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
        "max_confidence",
    )
    return reports.select("scan_id", reporting.report_json(reports.drop("scan_id")).alias("report"))


# Pieces of the comments on ``numbered (project_id, i, scan_id, risk_score, n)`` and ``drifted (project_id, trend, score)``.
SQL_COMMENT_PIECES = f"""ends AS (SELECT project_id, count(*) AS rows FROM numbered GROUP BY 1)
    SELECT project_id, 1 AS ordinal, '{reporting.comment_head()}' AS piece FROM ends
    UNION ALL
    SELECT project_id, i + 1, chr(10) || '| `scan/' || scan_id || '` | ' || printf('%.4f', risk_score) || ' | '
      || CASE {roles.SQL_TIER.format('risk_score')} WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡'
         ELSE '🟢' END || ' ' || {roles.SQL_TIER.format('risk_score')} || ' | ' || coalesce(n, 0) || ' |' FROM numbered
    UNION ALL
    SELECT project_id, rows + 2, coalesce(chr(10) || chr(10) || '{reporting.DRIFT_WORDS[0]}' || trend || ' ' || CASE trend
        WHEN 'STABLE' THEN '→' WHEN 'IMPROVED' THEN '↓' ELSE '↑' END || ' ' || printf('%.4f', score)
        || '{reporting.DRIFT_WORDS[1]}', '') || chr(10) || chr(10) || '{reporting.COMMENT_MARKER}'
    FROM ends LEFT JOIN drifted USING (project_id)"""


@query(
    "pr_markdown",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, means AS (
      SELECT project_id, avg(risk_score) FILTER (created_at >= TIMESTAMP '{SPLIT}') - avg(risk_score) FILTER
        (created_at < TIMESTAMP '{SPLIT}') AS change FROM scans GROUP BY 1),
    drifted AS (SELECT project_id, CASE WHEN abs(change) < 0.05 THEN 'STABLE' WHEN change < 0 THEN 'IMPROVED'
        WHEN abs(change) >= 0.5 THEN 'FRACTURED' ELSE 'DEGRADED' END AS trend, abs(change) AS score FROM means
      WHERE change IS NOT NULL),
    counts AS (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scan_id) AS i
      FROM scans LEFT JOIN counts USING (scan_id)),
    {SQL_COMMENT_PIECES}""",
)
def pr_markdown(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.operators.drift import drift

    scans = roles.scans(spark, folder)
    current = F.col("created_at") >= F.lit(SPLIT).cast("timestamp_ntz")
    means = scans.groupBy("project_id").agg(
        F.avg(F.when(~current, F.col("risk_score"))).alias("risk_before"),
        F.avg(F.when(current, F.col("risk_score"))).alias("risk_after"),
    )
    # a pull request carries no profiles: only the change of risk takes part
    none = F.lit(None).cast("double")
    paired = means.where("risk_before is not null and risk_after is not null").select(
        "*", none.alias("key_distance"), none.alias("vector_change")
    )
    drifts = drift(paired).select("project_id", F.col("risk_trend").alias("trend"), F.col("drift_score").alias("score"))
    counts = roles.findings(spark, folder).groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))
    rows = scans.join(counts, "scan_id", "left").select(
        "project_id",
        "scan_id",
        F.concat(F.lit("scan/"), F.col("scan_id").cast("string")).alias("file_path"),
        "risk_score",
        risk_tier(F.col("risk_score")).alias("risk_tier"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
    )
    return reporting.markdown_comments(rows, drifts, "project_id", [F.col("scan_id")])


@query(
    "udtf_scan",
    f"WITH {roles.sql_rule_findings('documents', 'doc_id', 'text')} SELECT doc_id, line_number::INT AS line_number, "
    "category, severity, confidence_score, node_path FROM rule_hits",
)
def udtf_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = roles.files(spark, folder).select("doc_id", "text")
    scanner.register(spark, "rule_scanner", scanner.rule_scanner())
    return scanner.scan_with(files, "rule_scanner", "doc_id", "text")
