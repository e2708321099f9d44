"""Results kept between runs: analysis by content, and built tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.keyed import RULE_SET_VERSION, content_key, unanalysed
from riskloom.session import configure, settle


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: a small table beside it says so."""
    try:
        return not spark.read.schema("done BOOLEAN").parquet(f"{path}.done").isEmpty()
    except AnalysisException:
        return False


def finish(spark: SparkSession, path: str) -> None:
    """Say that a table was written to its end."""
    spark.range(1).selectExpr("true AS done").write.mode("overwrite").parquet(f"{path}.done")


def built_once(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table read from ``path``, built and written there first if it is missing or unfinished."""
    if not finished(spark, path):
        build().write.mode("overwrite").parquet(path)
        finish(spark, path)
    return configure(spark).read.schema(schema).parquet(path)


def analysed(
    files: DataFrame,
    key: str,
    content: str,
    path: str,
    schema: str,
    analyse: Callable[[DataFrame], DataFrame],
    rule_set: str = RULE_SET_VERSION,
) -> DataFrame:
    """Results of every file, running ``analyse`` only on contents no run has seen.

    ``analyse`` takes ``(content_key, content)`` rows, one per distinct new content, and returns rows of
    ``schema`` starting with ``content_key``. Its results are appended to the store at ``path``; copies
    of one content share them. Changing the rule set changes every key.
    """
    spark = configure(files.sparkSession)
    keyed = files.withColumn("content_key", content_key(F.col(content), rule_set))
    fresh = keyed
    if finished(spark, path):
        stored = spark.read.schema(schema).parquet(path).select("content_key")
        fresh = unanalysed(files, stored, content, rule_set)
    # one row per new content, whatever the number of copies; any copy's text will do, they are equal
    contents = fresh.groupBy("content_key").agg(F.first(content).alias(content))
    new = settle(analyse(contents))
    if not new.isEmpty():
        new.write.mode("append").parquet(path)
        finish(spark, path)
    results = spark.read.schema(schema).parquet(path).dropDuplicates(["content_key"])
    return keyed.select(key, "content_key").join(results, "content_key")
