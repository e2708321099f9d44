"""Report rows and documents: SARIF, JSON reports, Markdown tables, editor diagnostics.

A document is a list of pieces ``(key, ordinal, piece)``: its head, one piece per row, its foot. Pieces in order, put
together, are the document. An artifact of any size has one document, and no task holds all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.functions import levels, text
from riskloom.operators.ordering import ordinals

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
TOOL_NAME = "riskloom"
TOOL_VERSION = "0.1.0"
DEFAULT_URI = "analyzed-file"
COMMENT_MARKER = "<!-- riskloom-report -->"
# The wording of a comment is an output contract.
COMMENT_TITLE = "Risk analysis"
COMMENT_COLUMNS = ("| File | Risk Score | Tier | Findings |", "|------|-----------|------|----------|")
DRIFT_WORDS = ("**Drift:** ", " from baseline")


def collated(name: Column) -> Column:
    """Text as a reader sorts it: accents and case count only between words that are otherwise equal."""
    return F.collate(name.cast("string"), "UNICODE")


def table_order(rows: DataFrame, columns: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort keys of a data table: nulls last either way, numbers as numbers, all else as text in the reader's order."""
    order = []
    for name, direction in columns:
        key = F.col(name) if isinstance(rows.schema[name].dataType, NumericType) else collated(F.col(name))
        order.append(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last())
    return order


def severity_pill(findings: DataFrame, active: str) -> DataFrame:
    """Findings of one severity, or all of them."""
    return findings if active == "all" else findings.where(F.col("severity") == active)


def security_results(findings: DataFrame, artifact: str) -> DataFrame:
    """Report results of findings."""
    return findings.select(
        artifact,
        F.lit(0).alias("section"),
        F.col("category").alias("rule"),
        text.start_line(F.col("line_number")).cast("bigint").alias("line"),
        levels.report_level(F.col("severity")).alias("level"),
        text.finding_message(F.col("category"), F.col("node_path"), F.col("confidence_score")).alias("message"),
    )


def function_results(functions: DataFrame, artifact: str) -> DataFrame:
    """Report results of functions past the anomaly gate; their line comes from the key, unclamped."""
    key, z = F.col("function_key"), F.col("renyi_z_score")
    return functions.where(levels.function_anomaly(z)).select(
        artifact,
        F.lit(1).alias("section"),
        F.lit("structural-anomaly").alias("rule"),
        text.key_line(key).alias("line"),
        F.lit("warning").alias("level"),
        text.function_anomaly_message(key, z, F.col("mahalanobis_distance")).alias("message"),
    )


def module_results(modules: DataFrame, artifact: str) -> DataFrame:
    """Report results of modules past the anomaly gate."""
    z = F.col("renyi_z_score")
    return modules.where(levels.module_anomaly(z)).select(
        artifact,
        F.lit(2).alias("section"),
        F.lit("structural-anomaly").alias("rule"),
        F.lit(1).cast("bigint").alias("line"),
        F.lit("warning").alias("level"),
        text.module_anomaly_message(z, F.col("mahalanobis_distance")).alias("message"),
    )


def file_risk_rows(files: DataFrame, key: str) -> DataFrame:
    """One file-level diagnostic for each HIGH or CRITICAL file."""
    return files.where(F.col("risk_tier").isin("HIGH", "CRITICAL")).select(
        key,
        F.lit("Warning").alias("level"),
        F.lit(0).alias("line"),
        text.file_risk_message(F.col("risk_tier"), F.col("risk_score")).alias("message"),
    )


def editor_findings(findings: DataFrame, key: str) -> DataFrame:
    """Editor diagnostics of findings."""
    severity, category, node = F.col("severity"), F.col("category"), F.col("node_path")
    return findings.select(
        key,
        "severity",
        levels.editor_level(severity).alias("level"),
        text.editor_line(F.col("line_number")).alias("line"),
        text.editor_message(severity, category, node, F.col("confidence_score")).alias("message"),
        text.hover_text(severity, category, node).alias("hover"),
    )


def _sarif_result(uri: Column) -> Column:
    location = F.struct(
        F.struct(
            F.struct(uri.alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.struct(
        F.col("rule").alias("ruleId"),
        F.col("level").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location).alias("locations"),
    )


_HEAD, _FOOT = -1, 1 << 30


def _pieces(rows: DataFrame, ends: DataFrame, key: str, order: Sequence[Column], joint: str, piece: Column) -> DataFrame:
    """Number heads, rows and feet together; rows after the first start with ``joint``.

    ``rows (key, section, ...)`` has the columns of ``order`` and ``piece``; ``ends (key, section, _end)`` holds the heads
    (section -1) and feet. Pieces are written after the numbering, so only what they are made of is sorted.
    """
    together = rows.unionByName(ends, allowMissingColumns=True)
    numbered = ordinals(together, [key], [F.col("section"), *order], "ordinal")
    inner = (F.col("section") > _HEAD) & (F.col("section") < _FOOT)
    written = F.concat(F.when(F.col("ordinal") > 2, F.lit(joint)).otherwise(F.lit("")), piece)
    return numbered.select(key, "ordinal", F.when(inner, written).otherwise(F.col("_end")).alias("piece"))


def _ends(keys: DataFrame, head: Column, foot: Column) -> DataFrame:
    """The first and the last piece of every document."""
    both = F.array(
        F.struct(F.lit(_HEAD).alias("section"), head.alias("_end")),
        F.struct(F.lit(_FOOT).alias("section"), foot.alias("_end")),
    )
    return keys.select(keys.columns[0], F.explode(both).alias("e")).select(keys.columns[0], "e.section", "e._end")


def sarif_documents(artifacts: DataFrame, results: DataFrame, artifact: str, order: Sequence[Column]) -> DataFrame:
    """SARIF documents as pieces ``(artifact, ordinal, piece)``; an artifact without results keeps an empty list."""
    uri = F.coalesce(F.nullif(F.col(artifact).cast("string"), F.lit("")), F.lit(DEFAULT_URI))
    driver = F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(TOOL_VERSION).alias("version"))
    schema = F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version")))
    head = F.concat(
        F.substring(schema, F.lit(1), F.length(schema) - 1),
        F.lit(',"runs":[{"tool":'),
        F.to_json(F.struct(driver.alias("driver"))),
        F.lit(',"results":['),
    )
    ends = _ends(artifacts.select(artifact), head, F.lit("]}]}"))
    return _pieces(results, ends, artifact, order, ",", F.to_json(_sarif_result(uri)))


def report_json(reports: DataFrame, pretty: bool = False) -> Column:
    """Whole report rows as JSON; null fields stay visible."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return F.to_json(F.struct(*[F.col(c) for c in reports.columns]), options)


def comment_row() -> Column:
    """One Markdown table row of a result; a missing tier reads UNKNOWN."""
    tier = F.coalesce("risk_tier", F.lit("UNKNOWN"))
    return F.concat(
        F.lit("| `"), F.col("file_path"), F.lit("` | "), text.fixed(F.col("risk_score"), 4), F.lit(" | "),
        levels.tier_symbol(tier), F.lit(" "), tier, F.lit(" | "), F.col("findings_count").cast("string"), F.lit(" |"),
    )


def drift_line(trend: Column, score: Column) -> Column:
    before, after = DRIFT_WORDS
    return F.concat(
        F.lit(before), trend, F.lit(" "), levels.trend_arrow(trend), F.lit(" "), text.fixed(score, 4), F.lit(after)
    )


def comment_head(title: str = COMMENT_TITLE) -> str:
    """What stands above the rows of a comment."""
    return "\n".join([f"## {title}", "", *COMMENT_COLUMNS])


def markdown_comments(
    results: DataFrame, drift: DataFrame, key: str, order: Sequence[Column], title: str = COMMENT_TITLE
) -> DataFrame:
    """Markdown comments as pieces ``(key, ordinal, piece)``: a table of results, a drift line if known, the marker last."""
    rows = results.withColumn("section", F.lit(0))
    line = drift_line(F.coalesce("trend", F.lit("UNKNOWN")), F.coalesce("score", F.lit(0.0)))
    keys = results.select(key).distinct().join(drift.select(key, line.alias("_drift")), key, "left")
    foot = F.concat(
        F.coalesce(F.concat(F.lit("\n\n"), F.col("_drift")), F.lit("")), F.lit("\n\n" + COMMENT_MARKER)
    )
    return _pieces(rows, _ends(keys, F.lit(comment_head(title)), foot), key, order, "", F.concat(F.lit("\n"), comment_row()))
