"""Queries on findings: rule scans, severity counts, sorted tables, level maps, editor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import levels, text
from riskloom.operators import reporting, rollups
from riskloom.operators.findings import rule_table, scan
from riskloom.operators.ordering import left_join_many, ordinals
from riskloom.operators.rule_index import scan_indexed
from riskloom.plans import roles
from riskloom.plans.registry import query
from riskloom.session import settle, spread
from riskloom.sources.tables import table

_HITS = "SELECT {key}, line_number::INT AS line_number, category, severity, confidence_score, node_path FROM rule_hits"


@query(
    "rule_findings",
    f"WITH {roles.sql_rule_findings('documents', 'doc_id', 'text')} {_HITS.format(key='doc_id')}",
)
def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return scan(roles.files(spark, folder), "doc_id", "text", rule_table(spark))


@query(
    "indexed_findings",
    f"WITH {roles.sql_rule_findings('documents', 'doc_id', 'text')} {_HITS.format(key='doc_id')}",
)
def indexed_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of ``rule_findings``, by the index of the rules' trigrams."""
    return scan_indexed(roles.files(spark, folder), "doc_id", "text", rule_table(spark))


@query(
    "html_findings",
    f"WITH {roles.sql_rule_findings('pages', 'page_id', 'html')} {_HITS.format(key='page_id')}",
)
def html_findings(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return scan(pages, "page_id", "html")


@query(
    "findings_by_severity_rollup",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}
    SELECT CASE WHEN grouping(s.severity) = 1 THEN 'all' ELSE s.severity END AS pill, count(*) AS n
    FROM findings f JOIN scans s USING (scan_id) GROUP BY ROLLUP (s.severity)""",
)
def findings_by_severity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    per_scan = roles.findings(spark, folder).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    scans = roles.scans(spark, folder).select("scan_id", "severity")
    return rollups.severity_pills(per_scan.join(scans, "scan_id"))


@query(
    "severity_histogram",
    """SELECT coalesce(sev, 'LOW') AS severity, count(*) AS findings,
              CAST(sum(count(*)) OVER () AS BIGINT) AS total_findings
    FROM (SELECT CASE WHEN l_quantity > 40 THEN 'CRITICAL' WHEN l_quantity > 30 THEN 'HIGH'
                      WHEN l_quantity > 20 THEN 'MEDIUM' WHEN l_quantity > 10 THEN 'LOW' END AS sev FROM lineitem)
    GROUP BY 1""",
)
def severity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = roles.findings(spark, folder)
    raw = F.when(F.col("severity") != "info", F.upper("severity"))
    return rollups.severity_histogram(found.select(raw.alias("severity")))


_PIVOT_SQL = ", ".join(
    f"count(f.scan_id) FILTER (f.severity = '{name}') AS {name}_count" for name in levels.SEVERITIES
)


@query(
    "scan_severity_pivot",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}
    SELECT s.scan_id, count(f.scan_id) AS findings_count, {_PIVOT_SQL}
    FROM scans s LEFT JOIN findings f USING (scan_id) GROUP BY s.scan_id""",
)
def scan_severity_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.scan_counts(roles.scans(spark, folder).select("scan_id"), roles.findings(spark, folder))


@query(
    "sorted_findings_nulls_last",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS},
    rows AS (SELECT s.scan_id, f.category, f.confidence_score, f.part_id, f.rule_id, f.line_number, f.weight
             FROM scans s LEFT JOIN findings f USING (scan_id))
    SELECT scan_id, category, round(confidence_score, 4) AS confidence_score, part_id, rule_id,
           row_number() OVER (ORDER BY lower(category) DESC NULLS LAST, confidence_score ASC NULLS LAST,
             scan_id, line_number, part_id, rule_id, weight) AS position
    FROM rows""",
)
def sorted_findings_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder).select("scan_id")
    found = roles.findings(spark, folder).select(
        "scan_id", "category", "confidence_score", "part_id", "rule_id", "line_number", "weight"
    )
    # sizing, range sampling and sorting each read the joined rows: join once
    rows = settle(left_join_many(scans, found, "scan_id", ["part_id", "line_number", "weight"]))
    order = reporting.table_order(rows, [("category", "desc"), ("confidence_score", "asc")])
    ties = [F.col(c).asc_nulls_last() for c in ("scan_id", "line_number", "part_id", "rule_id", "weight")]
    placed = ordinals(rows, [], [*order, *ties], "position")
    shown = F.round("confidence_score", 4).alias("confidence_score")
    return placed.select("scan_id", "category", shown, "part_id", "rule_id", "position")


@query(
    "level_maps",
    f"""WITH {roles.SQL_SCANS}, labelled AS (
      SELECT scan_id, risk_score, severity,
             CASE status WHEN 'F' THEN upper(severity) WHEN 'O' THEN severity END AS given,
             CASE status WHEN 'F' THEN 'FRACTURED' WHEN 'O' THEN 'IMPROVED' ELSE 'STABLE' END AS trend
      FROM scans)
    SELECT scan_id, given,
      CASE given WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
                 WHEN 'LOW' THEN 'note' ELSE 'warning' END AS report_level,
      CASE given WHEN 'CRITICAL' THEN 'Error' WHEN 'HIGH' THEN 'Warning' WHEN 'MEDIUM' THEN 'Information'
                 WHEN 'LOW' THEN 'Hint' ELSE 'Information' END AS editor_level,
      CASE upper(given) WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡'
                        WHEN 'LOW' THEN '🟢' ELSE '⚪' END AS symbol,
      CASE trend WHEN 'FRACTURED' THEN '↑' WHEN 'IMPROVED' THEN '↓' ELSE '→' END AS arrow,
      {roles.SQL_TIER.format('risk_score')} AS tier,
      CASE WHEN risk_score >= 0.9 THEN 'CRITICAL' WHEN risk_score >= 0.5 THEN 'HIGH'
           WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS strict_tier,
      CASE WHEN risk_score * 10 <= 3.9 THEN 'Low' WHEN risk_score * 10 <= 6.9 THEN 'Medium'
           WHEN risk_score * 10 <= 8.9 THEN 'High' ELSE 'Critical' END AS band
    FROM labelled""",
)
def level_maps(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("status")
    given = F.when(status == "F", F.upper("severity")).when(status == "O", F.col("severity"))
    trend = F.when(status == "F", F.lit("FRACTURED")).when(status == "O", F.lit("IMPROVED")).otherwise(F.lit("STABLE"))
    labelled = roles.scans(spark, folder).select("scan_id", "risk_score", given.alias("given"), trend.alias("trend"))
    return labelled.select(
        "scan_id",
        "given",
        levels.report_level(F.col("given")).alias("report_level"),
        levels.editor_level(F.col("given")).alias("editor_level"),
        levels.tier_symbol(F.col("given")).alias("symbol"),
        levels.trend_arrow(F.col("trend")).alias("arrow"),
        levels.risk_tier(F.col("risk_score")).alias("tier"),
        levels.risk_tier(F.col("risk_score"), 0.9).alias("strict_tier"),
        levels.risk_band(F.col("risk_score") * 10).alias("band"),
    )


_TIERED = f"""tiered AS (
  SELECT *, {roles.SQL_TIER.format('risk_score')} AS risk_tier FROM scans)"""


@query(
    "union_results",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, {_TIERED}, results AS (
      SELECT scan_id, 0 AS section, category AS rule, greatest(1, line_number) AS line,
        CASE upper(severity) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
             WHEN 'LOW' THEN 'note' ELSE 'warning' END AS level FROM findings
      UNION ALL
      SELECT scan_id, 1, 'structural-anomaly', line_number, 'warning' FROM findings WHERE confidence_score >= 0.9
      UNION ALL
      SELECT scan_id, 2, 'structural-anomaly', 1, 'warning' FROM scans WHERE risk_score * 2 >= 1.5
      UNION ALL
      SELECT scan_id, 3, 'file-risk', 0, 'Warning' FROM tiered WHERE risk_tier IN ('HIGH', 'CRITICAL'))
    SELECT scan_id, section, rule, line, level, count(*) AS copies FROM results GROUP BY ALL""",
)
def union_results(spark: SparkSession, folder: str) -> DataFrame:
    scans, found = roles.scans(spark, folder), roles.findings(spark, folder)
    security = reporting.security_results(found.withColumn("severity", F.upper("severity")), "scan_id")
    gated = found.where("confidence_score >= 0.9")
    anomalies = gated.select(
        "scan_id",
        F.lit(1).alias("section"),
        F.lit("structural-anomaly").alias("rule"),
        F.col("line_number").alias("line"),
        F.lit("warning").alias("level"),
    )
    module = scans.where(levels.module_anomaly(F.col("risk_score") * 2)).select(
        "scan_id",
        F.lit(2).alias("section"),
        F.lit("structural-anomaly").alias("rule"),
        F.lit(1).alias("line"),
        F.lit("warning").alias("level"),
    )
    tiered = scans.withColumn("risk_tier", levels.risk_tier(F.col("risk_score")))
    file_rows = reporting.file_risk_rows(tiered, "scan_id").select(
        "scan_id", F.lit(3).alias("section"), F.lit("file-risk").alias("rule"), "line", "level"
    )
    union = security.select("scan_id", "section", "rule", "line", "level")
    for part in (anomalies, module, file_rows):
        union = union.unionByName(part)
    return union.groupBy("scan_id", "section", "rule", "line", "level").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "editor_rows",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, {_TIERED}, rows AS (
      SELECT scan_id, upper(severity) AS severity, greatest(0, line_number - 1) AS line,
        CASE upper(severity) WHEN 'CRITICAL' THEN 'Error' WHEN 'HIGH' THEN 'Warning' WHEN 'MEDIUM' THEN 'Information'
             WHEN 'LOW' THEN 'Hint' ELSE 'Information' END AS level,
        '[' || upper(severity) || '] ' || category || ' | ' || node_path || ' | confidence '
          || CAST(CAST(round(confidence_score * 100) AS BIGINT) AS VARCHAR) || '%' AS message,
        '[' || upper(severity) || '] ' || category || ': ' || node_path AS hover
      FROM findings WHERE severity = 'high'
      UNION ALL
      SELECT scan_id, NULL, 0, 'Warning',
             'Structural Risk: ' || risk_tier || ' (score ' || printf('%.4f', risk_score) || ')', NULL
      FROM tiered WHERE risk_tier IN ('HIGH', 'CRITICAL'))
    SELECT s.scan_id, coalesce(r.level, 'none') AS level, r.severity, r.line, r.message, r.hover, count(*) AS copies
    FROM scans s LEFT JOIN rows r USING (scan_id) GROUP BY ALL""",
)
def editor_rows(spark: SparkSession, folder: str) -> DataFrame:
    scans = roles.scans(spark, folder)
    found = reporting.severity_pill(roles.findings(spark, folder), "high").withColumn("severity", F.upper("severity"))
    rows = reporting.editor_findings(found, "scan_id").unionByName(
        reporting.file_risk_rows(scans.withColumn("risk_tier", levels.risk_tier(F.col("risk_score"))), "scan_id"),
        allowMissingColumns=True,
    )
    # one row per distinct diagnostic before the look-up, so repeated rows never travel twice
    counted = rows.groupBy("scan_id", "level", "severity", "line", "message", "hover").agg(
        F.count(F.lit(1)).alias("copies")
    )
    joined = left_join_many(scans.select("scan_id"), counted, "scan_id", ["message"])
    return joined.select(
        "scan_id",
        F.coalesce("level", F.lit("none")).alias("level"),
        "severity",
        "line",
        "message",
        "hover",
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
    )


@query(
    "severity_buckets",
    f"""WITH {roles.SQL_FINDINGS}
    SELECT scan_id, upper(severity) AS severity, greatest(0, line_number - 1) AS line,
      '[' || upper(severity) || '] ' || category || ': ' || node_path AS hover,
      row_number() OVER (PARTITION BY scan_id, upper(severity) ORDER BY greatest(0, line_number - 1),
        '[' || upper(severity) || '] ' || category || ': ' || node_path, part_id, rule_id) AS place
    FROM findings WHERE severity <> 'info'""",
)
def severity_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Decorations of every bucket (scan and severity) in line order, each with its hover text."""
    found = roles.findings(spark, folder).where("severity <> 'info'").withColumn("severity", F.upper("severity"))
    shown = found.select(
        "scan_id", "severity", text.editor_line(F.col("line_number")).alias("line"),
        text.hover_text(F.col("severity"), F.col("category"), F.col("node_path")).alias("hover"), "part_id", "rule_id",
    )
    order = [F.col(c) for c in ("line", "hover", "part_id", "rule_id")]
    placed = ordinals(shown, ["scan_id", "severity"], order, "place")
    return placed.select("scan_id", "severity", "line", "hover", "place")


@query(
    "display_strings",
    f"""WITH {roles.SQL_SCANS}, {roles.SQL_FINDINGS}, counts AS (
      SELECT scan_id, count(*) AS n, max(confidence_score) AS c, max(node_path) AS p, max(category) AS k
      FROM findings GROUP BY 1),
    shown AS (SELECT s.*, coalesce(n, 0) AS n, c, p, k, {roles.SQL_TIER.format('risk_score')} AS tier
              FROM scans s LEFT JOIN counts USING (scan_id))
    SELECT scan_id,
      k || ': ' || p || ' (confidence=' || printf('%.2f', c) || ')' AS message,
      'Structural anomaly in fn@' || scan_id || ':0 (Anomaly Z=' || printf('%.2f', risk_score * 3)
        || ', Mahalanobis=' || printf('%.2f', risk_score * 7) || ')' AS anomaly,
      'Module-level structural anomaly (Anomaly Z=' || printf('%.2f', risk_score * 3) || ', Mahalanobis='
        || printf('%.2f', risk_score * 7) || ')' AS module_anomaly,
      printf('%.2f', risk_score) || ' [' || tier || ']' AS status_line,
      'Score: ' || printf('%.4f', risk_score) || chr(10) || 'Tier: ' || tier || chr(10)
        || 'Weights: A=0.25 V=0.25 S=0.50' || chr(10) || 'Findings: ' || n || chr(10) || 'Functions: 0' AS detail,
      strftime(created_at, '%Y-%m-%d') AS last_scan,
      n || ' finding' || CASE WHEN n <> 1 THEN 's' ELSE '' END AS counted,
      upper(substr(severity, 1, 1)) || substr(severity, 2) AS badge
    FROM shown""",
)
def display_strings(spark: SparkSession, folder: str) -> DataFrame:
    counts = roles.findings(spark, folder).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("confidence_score").alias("c"),
        F.max("node_path").alias("p"),
        F.max("category").alias("k"),
    )
    scans = roles.scans(spark, folder)
    shown = scans.join(counts, "scan_id", "left").na.fill(0, ["n"])
    score, tier = F.col("risk_score"), levels.risk_tier(F.col("risk_score"))
    key = F.concat(F.lit("fn@"), F.col("scan_id").cast("string"), F.lit(":0"))
    weights = [F.lit(0.25), F.lit(0.25), F.lit(0.5)]
    return shown.select(
        "scan_id",
        text.finding_message(F.col("k"), F.col("p"), F.col("c")).alias("message"),
        text.function_anomaly_message(key, score * 3, score * 7).alias("anomaly"),
        text.module_anomaly_message(score * 3, score * 7).alias("module_anomaly"),
        text.status_line(score, tier).alias("status_line"),
        text.status_detail(score, tier, weights, F.col("n"), F.lit(0)).alias("detail"),
        F.date_format("created_at", "yyyy-MM-dd").alias("last_scan"),
        text.plural(F.col("n"), "finding").alias("counted"),
        text.capitalised(F.col("severity")).alias("badge"),
    )
