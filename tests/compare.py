"""Compare a Spark query with its SQL check, row by row, without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    expected = rows_of(names, relation.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if actual == expected:
        return None
    extra, missing = list((actual - expected).items())[:3], list((expected - actual).items())[:3]
    return f"rows {sum(actual.values())} vs {sum(expected.values())}\n only spark: {extra}\n only sql: {missing}"
