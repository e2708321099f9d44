"""Rule-table scan: text in, one row per (line, rule) finding out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One row of the rule table. Patterns avoid look-around and back-references, so they run anywhere.

    ``hints`` are lower-case literals; every match contains at least one. A line without any of them
    skips the pattern, and a plain substring search costs a fraction of a pattern search.

    ``\\s`` is one of the six ASCII spaces and ``\\b`` the edge of a run of ASCII letters, digits and ``_`` wherever the rule
    runs; ``jvm_pattern`` and ``portable_pattern`` say so to engines that mean more, or less, by them.
    """

    category: str
    severity: str
    confidence: float
    pattern: str
    hints: tuple[str, ...] = ()

    @property
    def portable_pattern(self) -> str:
        """For engines where ``\\b`` is ASCII already."""
        return self.pattern.replace(r"\s", r"[ \t\n\r\f\x0B]")

    @property
    def jvm_pattern(self) -> str:
        """For Spark, where ``\\b`` also knows other letters."""
        word = "[0-9A-Za-z_]"
        edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
        return self.portable_pattern.replace(r"\b", edge)


RULES: tuple[Rule, ...] = (
    Rule(
        "sql-injection", "CRITICAL", 0.9,
        r"(?is)(select|insert|update|delete)\s.*(from|into|set)\s.*[\"']\s*(\+|%|\.format)",
        ("select", "insert", "update", "delete"),
    ),
    Rule(
        "sql-injection", "HIGH", 0.7,
        r"\.execute\(\s*f[\"']",
        (".execute(",),
    ),
    Rule(
        "path-traversal", "MEDIUM", 0.6,
        r"open\(\s*(user_input|request|input\()",
        ("open(",),
    ),
    Rule(
        "path-traversal", "MEDIUM", 0.5,
        r"\.\./\.\./",
        ("../",),
    ),
    Rule(
        "hardcoded-secret", "HIGH", 0.8,
        r"(?i)(password|passwd|secret|api_?key|token)\s*=\s*[\"'][^\"']{6,}[\"']",
        ("password", "passwd", "secret", "apikey", "api_key", "token"),
    ),
    Rule(
        "hardcoded-secret", "CRITICAL", 0.95,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        ("-----begin",),
    ),
    Rule(
        "dynamic-eval", "CRITICAL", 0.85,
        r"\b(eval|exec)\s*\(",
        ("eval", "exec"),
    ),
    Rule(
        "command-injection", "CRITICAL", 0.9,
        r"\bos\.(system|popen)\s*\(",
        ("os.",),
    ),
    Rule(
        "command-injection", "HIGH", 0.75,
        r"shell\s*=\s*True",
        ("shell",),
    ),
    Rule(
        "unsafe-deserialization", "HIGH", 0.8,
        r"\b(pickle|marshal|shelve)\.loads?\s*\(",
        ("load",),
    ),
    Rule(
        "unsafe-deserialization", "MEDIUM", 0.6,
        r"yaml\.load\s*\(",
        ("yaml.load",),
    ),
    Rule(
        "weak-hash", "LOW", 0.5,
        r"(?i)hashlib\.(md5|sha1)\s*\(",
        ("hashlib.",),
    ),
    Rule(
        "insecure-transport", "LOW", 0.3,
        r"http://[A-Za-z0-9]",
        ("http://",),
    ),
    Rule(
        "insecure-transport", "MEDIUM", 0.6,
        r"verify\s*=\s*False",
        ("verify",),
    ),
    Rule(
        "cross-site-scripting", "MEDIUM", 0.4,
        r"(?i)(<script[^>]*>|javascript:|document\.write\s*\()",
        ("<script", "javascript:", "document.write"),
    ),
    Rule(
        "hardcoded-address", "LOW", 0.4,
        r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    ),
)

CATEGORIES: tuple[str, ...] = tuple(dict.fromkeys(rule.category for rule in RULES))

# How much one certain finding of a severity weighs in the security score.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.6, "MEDIUM": 0.3, "LOW": 0.1}


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of every file, numbered from 1."""
    split = F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")
    return files.select(key, split).select(key, (F.col("_at") + 1).alias("line_number"), "line")


def _matches(rule: Rule) -> Column:
    """Whether a line matches a rule, by its hints first."""
    match = F.col("line").rlike(rule.jvm_pattern)
    if not rule.hints:
        return match
    return reduce(or_, [F.col("_lower").contains(hint) for hint in rule.hints]) & match


def _matching_rules(rules: Sequence[Rule]) -> Column:
    """Indexes of the rules a line matches."""
    return F.array_compact(F.array(*[F.when(_matches(r), F.lit(i)) for i, r in enumerate(rules)]))


def _rule_attributes(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.category).alias("category"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.confidence).alias("confidence_score"),
                F.lit(r.jvm_pattern).alias("pattern"),
            )
            for r in rules
        ]
    )


RULE_TABLE = "category STRING, severity STRING, confidence DOUBLE, pattern STRING, hints ARRAY<STRING>"


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rules as a table."""
    return spark.createDataFrame([(r.category, r.severity, r.confidence, r.pattern, list(r.hints)) for r in rules], RULE_TABLE)


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table ``(category, severity, confidence, pattern, hints)``; a rule table is small, like a program."""
    rows = table.select(*[field.split()[0] for field in RULE_TABLE.split(", ")]).collect()
    return tuple(Rule(r.category, r.severity, r.confidence, r.pattern, tuple(r.hints or ())) for r in rows)


def scan(files: DataFrame, key: str, text: str, rules: Sequence[Rule] | DataFrame = RULES) -> DataFrame:
    """Findings ``(key, line_number, category, severity, confidence_score, node_path)`` of whole texts.

    Narrow and stateless: no shuffle, one pass over the text, patterns compiled once per task.
    ``node_path`` is the matched fragment. ``rules`` may be a table.
    """
    if isinstance(rules, DataFrame):
        rules = rules_of(rules)
    lines = lines_of(files, key, text).withColumn("_lower", F.lower("line"))
    hits = lines.select(key, "line_number", "line", F.explode(_matching_rules(rules)).alias("_rule"))
    ruled = hits.select(key, "line_number", "line", F.get(_rule_attributes(rules), F.col("_rule")).alias("_r"))
    return ruled.select(
        key,
        "line_number",
        F.col("_r.category").alias("category"),
        F.col("_r.severity").alias("severity"),
        F.col("_r.confidence_score").alias("confidence_score"),
        F.call_function("regexp_extract", F.col("line"), F.col("_r.pattern"), F.lit(0)).alias("node_path"),
    )


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def security_summary(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-file finding count and security score ``1 - exp(-sum(weight * confidence))``."""
    load = F.sum(severity_weight(F.col("severity")) * F.col("confidence_score"))
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        (1 - F.exp(-load)).alias("security_score"),
    )
