"""Severity, tier, band and trend mappings.

The scales stay apart on purpose: report levels and editor levels disagree on HIGH, tiers run on a
0-1 score and bands on a 0-10 score.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mappings and thresholds that results must agree on.
REPORT_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
EDITOR_LEVELS = {"CRITICAL": "Error", "HIGH": "Warning", "MEDIUM": "Information", "LOW": "Hint"}
TIER_SYMBOLS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CRITICAL_THRESHOLD = 0.7
HIGH_THRESHOLD = 0.5
MEDIUM_THRESHOLD = 0.3
ANOMALY_Z = 1.5
ANOMALY_SCORE = 0.5


def lookup(values: dict[str, str], key: Column, default: str) -> Column:
    """``values[key]`` with a default for unknown or null keys."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def report_level(severity: Column) -> Column:
    """Level in the report document; case-sensitive, unknown is ``warning``."""
    return lookup(REPORT_LEVELS, severity, "warning")


def editor_level(severity: Column) -> Column:
    """Level of an editor diagnostic; unknown is ``Information``."""
    return lookup(EDITOR_LEVELS, severity, "Information")


def tier_symbol(tier: Column) -> Column:
    """Symbol of a tier, in any letter case; unknown is white."""
    return lookup(TIER_SYMBOLS, F.upper(tier), "⚪")


def trend_arrow(trend: Column) -> Column:
    """Arrow of a drift trend."""
    return (
        F.when(trend.isin("DEGRADED", "FRACTURED"), F.lit("↑"))
        .when(trend == "IMPROVED", F.lit("↓"))
        .otherwise(F.lit("→"))
    )


def risk_tier(score: Column, critical: float = CRITICAL_THRESHOLD) -> Column:
    """Tier of a 0-1 score; the critical threshold is a setting."""
    return (
        F.when(score >= critical, F.lit("CRITICAL"))
        .when(score >= HIGH_THRESHOLD, F.lit("HIGH"))
        .when(score >= MEDIUM_THRESHOLD, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def risk_band(score: Column) -> Column:
    """Band of a 0-10 score."""
    return (
        F.when(score <= 3.9, F.lit("Low"))
        .when(score <= 6.9, F.lit("Medium"))
        .when(score <= 8.9, F.lit("High"))
        .otherwise(F.lit("Critical"))
    )


def function_anomaly(z: Column) -> Column:
    """Function gate ``not z < 1.5``: NaN passes."""
    return ~(z < ANOMALY_Z)


def module_anomaly(z: Column) -> Column:
    """Module gate ``z >= 1.5``: NaN fails, though Spark orders NaN above every number."""
    return (z >= ANOMALY_Z) & ~F.isnan(z)


def scored_anomaly(score: Column) -> Column:
    """Benchmark gate ``anomaly_score >= 0.5``: NaN fails."""
    return (score >= ANOMALY_SCORE) & ~F.isnan(score)


def flagged(tier: Column, findings: Column) -> Column:
    """A file is flagged by a high tier or by any finding."""
    return F.coalesce(tier.isin("HIGH", "CRITICAL"), F.lit(False)) | (F.coalesce(findings, F.lit(0)) > 0)
