"""Scan with very many rules: an index of the rules' trigrams picks the few that a line can match.

``findings.scan`` tries every rule's hints on every line, which costs lines times rules. Here each hint is filed under one of
its trigrams, the one fewest hints share; a line asks for its own distinct trigrams, and only rules found so meet it: hint
first, then pattern. The cost grows with the text and with what is found. The findings are those of ``scan``.

A line asks by number: the first three UTF-8 bytes of a filed trigram. There are 2 ** 24 such numbers however many rules there
are, so a task marks the filed ones and looks up those of its lines in one pass; only lines that meet one, and only what they
met, go on. A number may stand for several trigrams, and the hint is searched in any case.

The rules stay a table. Beyond ``BROADCAST_ANCHORS`` filed hints it is not broadcast: then narrow rows of key, line number and
trigram meet it by shuffle, and the lines come in for the candidates only.

Defined cases: rules without hints, or with one of fewer than three characters, cannot be filed and are scanned as before;
equal rules count once; ``key`` names one text (lines of texts with equal keys are one where their numbers are equal);
null texts have no lines; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from riskloom.operators.findings import Rule, lines_of, scan

GRAM = 3
BROADCAST_ANCHORS = 100_000
_ATTRIBUTES = ("category", "severity", "confidence_score", "pattern")


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text of three characters or more."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda at: text.substr(at, F.lit(GRAM))))


def _jvm_pattern(pattern: Column) -> Column:
    """``Rule.jvm_pattern`` of a column, from the same two replacements."""
    for token in (r"\s", r"\b"):
        pattern = F.replace(pattern, F.lit(token), F.lit(Rule("", "", 0.0, token).jvm_pattern))
    return pattern


def anchors(rules: DataFrame) -> DataFrame:
    """One row per hint of every rule: its trigram, the hint, and the rule with an id."""
    named = rules.select(
        "category", "severity", F.col("confidence").alias("confidence_score"), _jvm_pattern(F.col("pattern")).alias("pattern"), "hints"
    )
    hints = named.select(F.xxhash64(*named.columns).alias("rule_id"), *_ATTRIBUTES, F.explode(F.array_distinct("hints")).alias("hint")).distinct()
    filed = hints.withColumn("gram", F.explode(_grams(F.col("hint"))))
    shared = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(shared, "gram").groupBy("rule_id", "hint", *_ATTRIBUTES)
    return rarest.agg(F.min(F.struct("n", F.xxhash64("gram").alias("h"), "gram")).alias("_r")).select(
        F.col("_r.gram").alias("gram"), "rule_id", "hint", *_ATTRIBUTES
    )


def _number(gram: Column) -> Column:
    """The first three bytes of a trigram as an integer."""
    return F.conv(F.substring(F.hex(F.encode(gram, "UTF-8")), 1, 6), 16, 10).cast("int")


def _met(numbers: np.ndarray):
    """Lines that hold a filed number, with the distinct ones they hold."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = np.zeros(1 << 24, bool)
        filed[numbers] = True
        for batch in batches:
            text = batch["_lower"].cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if not len(text) or offsets[-1] - offsets[0] < GRAM:
                continue
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
            number = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            at = np.flatnonzero(filed[number])
            ends = offsets[1:] - offsets[0]
            owner = np.searchsorted(ends, at, side="right")
            inside = at + GRAM <= ends[owner]
            pairs = np.unique((owner[inside] << 24) | number[at[inside]])
            lines, first = np.unique(pairs >> 24, return_index=True)
            lists = pa.ListArray.from_arrays(np.append(first, len(pairs)).astype(np.int32), (pairs & 0xFFFFFF).astype(np.int32))
            chosen = batch.take(pa.array(lines))
            yield pa.RecordBatch.from_arrays([*chosen.columns, lists], [*chosen.schema.names, "_numbers"])

    return look_up


def scan_indexed(files: DataFrame, key: str, text: str, rules: DataFrame, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Findings of ``findings.scan`` for a rule table ``(category, severity, confidence, pattern, hints)`` of any size."""
    fileable = F.coalesce((F.size("hints") > 0) & F.forall("hints", lambda h: F.length(h) >= GRAM), F.lit(False))
    table, rest = anchors(rules.where(fileable)).withColumn("_number", _number(F.col("gram"))), rules.where(~fileable).distinct()
    lines = lines_of(files, key, text).withColumn("_lower", F.lower("line"))
    numbers = table.groupBy("_number").agg(F.count(F.lit(1)).alias("n")).toArrow()
    schema = StructType([*lines.schema.fields, StructField("_numbers", ArrayType(IntegerType()))])
    asking = lines.mapInArrow(_met(numbers["_number"].to_numpy()), schema)
    if numbers["n"].to_numpy().sum() <= broadcast_anchors:
        met = asking.withColumn("_number", F.explode("_numbers")).join(F.broadcast(table), "_number")
    else:
        asked = asking.select(key, "line_number", F.explode("_numbers").alias("_number"))
        candidates = asked.join(table, "_number").select(F.col(key).alias("_key"), F.col("line_number").alias("_line"), "hint", "rule_id", *_ATTRIBUTES)
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("line_number") == F.col("_line"))
        met = candidates.join(lines, same)
    hits = met.where(F.contains("_lower", "hint")).where(F.rlike("line", F.col("pattern")))
    once = hits.select(
        key,
        "line_number",
        "rule_id",
        "category",
        "severity",
        "confidence_score",
        F.call_function("regexp_extract", F.col("line"), F.col("pattern"), F.lit(0)).alias("node_path"),
    ).dropDuplicates([key, "line_number", "rule_id"])
    found = once.drop("rule_id")
    return found if rest.isEmpty() else found.unionByName(scan(files, key, text, rest))
