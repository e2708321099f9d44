"""The input tables in the roles of the data model, as DataFrames and as SQL text for the checks.

orders are scans of projects (customers), lineitems are findings of scans, documents are files,
embeddings are function vectors, events are messages, conversations are pull-request comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.findings import RULES, SEVERITY_WEIGHTS, Rule
from riskloom.session import spread
from riskloom.sources.tables import table

PRIORITY_SEVERITY = {
    "1-URGENT": "critical",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "info",
    "5-LOW": "low",
}


def _priority_severity() -> Column:
    severity = F.lit(None).cast("string")
    for priority, name in PRIORITY_SEVERITY.items():
        severity = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(severity)
    return severity


def finding_severity(quantity: Column) -> Column:
    """Severity of one finding, by quantity band."""
    return (
        F.when(quantity > 40, F.lit("critical"))
        .when(quantity > 30, F.lit("high"))
        .when(quantity > 20, F.lit("medium"))
        .when(quantity > 10, F.lit("low"))
        .otherwise(F.lit("info"))
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("description"),
    )


def scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_rows(table(spark, folder, "orders"))


def scan_rows(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") / 500000).alias("risk_score"),
        _priority_severity().alias("severity"),
    )


def findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("rule_id"),
        finding_severity(F.col("l_quantity")).alias("severity"),
        F.concat_ws("-", F.lit("rule"), "l_returnflag", "l_linestatus").alias("category"),
        F.concat(F.lit("node/"), F.col("l_partkey").cast("string")).alias("node_path"),
        (F.col("l_discount") * 10).alias("confidence_score"),
        F.col("l_extendedprice").alias("weight"),
        F.col("l_shipdate").alias("found_at"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, over all cores: the scan of whole texts is what costs."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return spread(documents, "doc_id")


# The same roles as SQL common table expressions.
SQL_SCANS = """scans AS (
  SELECT o_orderkey AS scan_id, o_custkey AS project_id, o_orderstatus AS status, o_orderdate AS created_at,
         o_totalprice / 500000 AS risk_score,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
              WHEN '4-NOT SPECIFIED' THEN 'info' WHEN '5-LOW' THEN 'low' END AS severity
  FROM orders)"""

SQL_FINDINGS = """findings AS (
  SELECT l_orderkey AS scan_id, l_linenumber AS line_number, l_partkey AS part_id, l_suppkey AS rule_id,
         CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium'
              WHEN l_quantity > 10 THEN 'low' ELSE 'info' END AS severity,
         'rule-' || l_returnflag || '-' || l_linestatus AS category,
         'node/' || l_partkey AS node_path, l_discount * 10 AS confidence_score,
         l_extendedprice AS weight, l_shipdate AS found_at
  FROM lineitem)"""

SQL_PROJECTS = """projects AS (
  SELECT c_custkey AS project_id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS description
  FROM customer)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rule_findings(source: str, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """CTEs ``lines`` and ``rule_hits``: the rule table against every line, one branch per rule."""
    branches = "\n  UNION ALL ".join(
        f"SELECT {key}, line_number, {_quoted(r.category)} AS category, {_quoted(r.severity)} AS severity, "
        f"{r.confidence}::DOUBLE AS confidence_score, regexp_extract(line, {_quoted(r.portable_pattern)}, 0) AS node_path "
        f"FROM lines WHERE regexp_matches(line, {_quoted(r.portable_pattern)})"
        for r in rules
    )
    return f"""lines AS MATERIALIZED (
  SELECT {key}, unnest(string_split({text}, chr(10))) AS line,
         generate_subscripts(string_split({text}, chr(10)), 1) AS line_number
  FROM {source}),
rule_hits AS (
  {branches})"""


SQL_SEVERITY_WEIGHT = (
    "CASE severity "
    + " ".join(f"WHEN '{name}' THEN {value}::DOUBLE" for name, value in SEVERITY_WEIGHTS.items())
    + " ELSE 0 END"
)
SQL_TIER = "CASE WHEN {0} >= 0.7 THEN 'CRITICAL' WHEN {0} >= 0.5 THEN 'HIGH' WHEN {0} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"
