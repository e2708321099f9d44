"""Benchmark results as CSV, reports as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import round_half_even
from riskloom.operators.rollups import valid_results
from riskloom.session import configure
from riskloom.sources.files import path_order

CSV_SCHEMA = (
    "file_path STRING, risk_score DOUBLE, security_findings_count BIGINT, structural_anomalies_count BIGINT, "
    "risk_tier STRING"
)
CSV_COLUMNS = [field.split()[0] for field in CSV_SCHEMA.split(", ")]
_FORMAT = {"header": "true", "quote": '"', "escape": '"'}


def with_errors(results: DataFrame, failed: DataFrame) -> DataFrame:
    """Results plus one zero row of tier ERROR for each failed file."""
    zero = F.lit(0).cast("bigint")
    errors = failed.select(
        "file_path",
        F.lit(0.0).alias("risk_score"),
        zero.alias("security_findings_count"),
        zero.alias("structural_anomalies_count"),
        F.lit("ERROR").alias("risk_tier"),
    )
    return results.select(*CSV_COLUMNS).unionByName(errors)


def write_csv(results: DataFrame, path: str) -> None:
    """Fixed five-column CSV, in path order, scores with 4 decimals; replaces what was there."""
    rows = results.withColumn("risk_score", round_half_even(F.col("risk_score"), 4)).select(*CSV_COLUMNS)
    rows.orderBy(path_order(F.col("file_path"))).write.mode("overwrite").options(**_FORMAT).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed results without ERROR rows."""
    return valid_results(configure(spark).read.schema(CSV_SCHEMA).options(**_FORMAT).csv(path))


def write_documents(documents: DataFrame, column: str, path: str) -> None:
    """One document per line of text."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
