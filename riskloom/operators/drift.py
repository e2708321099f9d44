"""Drift between a baseline and a current snapshot.

The score weighs three parts: change of risk, Jaccard distance of the function keys, and relative
change of the feature vector. A part missing from either side drops out and the others share its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRIFT_WEIGHTS = {"risk": 0.4, "keys": 0.3, "vectors": 0.3}
STABLE_BELOW = 0.05
FRACTURED_FROM = 0.5


def jaccard_distance(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of function keys that only one snapshot has, from a keyed diff."""
    lost = F.count_if(F.col("change").isin("added", "removed"))
    return changes.groupBy(*keys).agg((lost / F.count(F.lit(1))).alias("key_distance"))


def relative_change(before: Column, after: Column) -> Column:
    """tanh of the L2 change relative to the baseline's length (any change from zero counts fully)."""
    pairs = F.zip_with(before, after, lambda a, b: (a - b) * (a - b))
    moved = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))
    length = F.sqrt(F.aggregate(before, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(moved == 0, F.lit(0.0)).when(length == 0, F.lit(1.0)).otherwise(F.tanh(moved / length))


def drift_score(risk_change: Column, key_distance: Column, vector_change: Column) -> Column:
    """Weighted mean of the parts that are there."""
    parts = {"risk": F.abs(risk_change), "keys": key_distance, "vectors": vector_change}
    total = weighted = F.lit(0.0)
    for name, part in parts.items():
        weight = F.when(part.isNotNull(), F.lit(DRIFT_WEIGHTS[name])).otherwise(F.lit(0.0))
        total = total + weight
        weighted = weighted + weight * F.coalesce(part, F.lit(0.0))
    return F.coalesce(F.try_divide(weighted, total), F.lit(0.0))


def trend(score: Column, risk_change: Column) -> Column:
    """STABLE below 0.05, IMPROVED when risk fell, FRACTURED from 0.5, else DEGRADED."""
    return (
        F.when(score < STABLE_BELOW, F.lit("STABLE"))
        .when(risk_change < 0, F.lit("IMPROVED"))
        .when(score >= FRACTURED_FROM, F.lit("FRACTURED"))
        .otherwise(F.lit("DEGRADED"))
    )


def drift(paired: DataFrame) -> DataFrame:
    """Drift score and trend of rows with ``risk_before, risk_after, key_distance, vector_change``."""
    risk_change = F.col("risk_after") - F.col("risk_before")
    scored = paired.withColumn("drift_score", drift_score(risk_change, F.col("key_distance"), F.col("vector_change")))
    return scored.withColumn("risk_trend", trend(F.col("drift_score"), risk_change))
