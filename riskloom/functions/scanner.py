"""Scanner plug-ins: code that reads one text and yields findings, as a table function.

The rule table covers most scanners as data. A plug-in is for what a pattern cannot say; it sees one
text at a time and keeps no state, so Spark spreads the texts as it likes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from riskloom.operators.findings import RULES, Rule

FINDING = "line_number INT, category STRING, severity STRING, confidence_score DOUBLE, node_path STRING"
Finding = tuple[int, str, str, float, str]
Scanner = Callable[[str], Iterable[Finding]]


def rule_scanner(rules: Sequence[Rule] = RULES) -> Scanner:
    """The rule table as a plug-in."""
    table = [(r.category, r.severity, r.confidence, re.compile(r.portable_pattern, re.ASCII)) for r in rules]

    def scan(text: str) -> Iterator[Finding]:
        for number, line in enumerate(text.split("\n"), 1):
            for category, severity, confidence, pattern in table:
                found = pattern.search(line)
                if found:
                    yield number, category, severity, confidence, found.group(0)

    return scan


def register(spark: SparkSession, name: str, scanner: Scanner) -> None:
    """Make a scanner callable as a table function of one text, fed and read in Arrow batches."""

    class Scan:
        def eval(self, text: str):
            if text is not None:
                yield from scanner(text)

    spark.udtf.register(name, udtf(Scan, returnType=FINDING, useArrow=True))


def scan_with(files: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """Findings of every file by a registered scanner."""
    view = f"{name}_{uuid.uuid4().hex}"
    files.createOrReplaceTempView(view)
    try:
        # the plan holds the files themselves from here on, so the name can go
        return files.sparkSession.sql(f"SELECT f.{key}, s.* FROM {view} f, LATERAL {name}(f.{text}) s")
    finally:
        files.sparkSession.catalog.dropTempView(view)
