"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import configure, shared_dir
from riskloom.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"  # a word, everywhere in this subpackage

__all__ = ["WORD", "configure", "documents", "let", "shared_dir", "stored", "table", "words"]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table of documents."""
    return table(spark, folder, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; null and wordless texts give an empty one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


