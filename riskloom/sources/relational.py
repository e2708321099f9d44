"""Relational tables of users, projects, scans, findings and baselines, over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from riskloom.session import configure

# Columns by which a table is read in parallel ranges.
RANGE_COLUMNS = {"users": "user_id", "projects": "project_id", "scans": "scan_id", "findings": "finding_id",
                 "baselines": "baseline_id"}
FETCH_ROWS = 10_000
WRITE_ROWS = 5_000


def reader(spark: SparkSession, url: str, name: str, options: dict[str, str] | None = None) -> DataFrameReader:
    """Reader of one table with the options every read shares."""
    base = configure(spark).read.format("jdbc").option("url", url).option("dbtable", name)
    return base.option("fetchsize", str(FETCH_ROWS)).options(**(options or {}))


def read_table(
    spark: SparkSession, url: str, name: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """A table as ``partitions`` parallel ranges of its id; filters and columns are pushed to the database."""
    ranged = {
        "partitionColumn": RANGE_COLUMNS[name],
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }
    return reader(spark, url, name, ranged | options).load()


def write_table(rows: DataFrame, url: str, name: str, connections: int = 16, **options: str) -> None:
    """Replace a table's rows over a bounded number of connections, keeping its definition."""
    writer = rows.write.format("jdbc").mode("overwrite").option("truncate", "true")
    settings = {"url": url, "dbtable": name, "batchsize": str(WRITE_ROWS), "numPartitions": str(connections)}
    writer.options(**(settings | options)).save()
