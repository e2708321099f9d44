"""Feature vectors per file, fused risk and tier, per-file results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.levels import risk_tier, scored_anomaly
from riskloom.operators.findings import CATEGORIES

FUNCTION_WIDTH = 14
POOLED_WIDTH = 56
ANOMALY_WIDTH = 16
THREAT_WIDTH = 18
THREAT_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Base weights of analyzer, validator and security. Security alone outweighs the other two together,
# so a file without findings cannot pass MEDIUM.
FUSION_WEIGHTS = (0.20, 0.25, 0.55)


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def vector_or_zeros(vector: Column, width: int) -> Column:
    """A vector, or zeros when there is none."""
    return F.coalesce(vector, zeros(width))


def folded(vector: Column, width: int) -> Column:
    """A vector of any length folded to ``width``: component i sums every element at i modulo width."""
    size = F.size(vector)

    def total(i: Column) -> Column:
        picked = F.filter(vector, lambda _, at: F.pmod(at, F.lit(width)) == i)
        return F.aggregate(picked, F.lit(0.0), lambda s, x: s + x.cast("double"))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), total)).otherwise(zeros(width))


def pooled_vectors(functions: DataFrame, file: str, vector: str, width: int = FUNCTION_WIDTH) -> DataFrame:
    """Mean, deviation, minimum and maximum of a file's function vectors, side by side (4 x width).

    Each statistic is a combinable aggregate per component: a file with a third of all functions
    reaches the shuffle as one partial row per task.
    """
    parts = [F.get(F.col(vector), F.lit(i)) for i in range(width)]
    pools = [
        F.array(*[F.avg(p) for p in parts]),
        F.array(*[F.stddev_pop(p) for p in parts]),
        F.array(*[F.min(p) for p in parts]),
        F.array(*[F.max(p) for p in parts]),
    ]
    return functions.groupBy(file).agg(F.concat(*pools).alias("aggregate_56d"))


def padded_vector(pooled: Column, module: Column, width: int = POOLED_WIDTH) -> Column:
    """Pooled vector, or the module vector repeated to full width when a file has no functions."""
    index = F.sequence(F.lit(0), F.lit(width - 1))
    repeated = F.transform(index, lambda i: F.get(module, F.pmod(i, F.size(module))))
    return F.coalesce(pooled, F.when(F.size(module) > 0, repeated), zeros(width))


def threat_columns(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 18 threat features per key: severity counts, category counts, totals and confidence."""
    severities = [
        F.count_if(F.col("severity") == s).cast("double").alias(f"severity_{s.lower()}") for s in THREAT_SEVERITIES
    ]
    categories = [
        F.count_if(F.col("category") == c).cast("double").alias(f"category_{c.replace('-', '_')}") for c in CATEGORIES
    ]
    # one presence flag per known category: no distinct aggregation
    present = sum((F.max((F.col("category") == c).cast("int")) for c in CATEGORIES), F.lit(0))
    return findings.groupBy(*keys).agg(
        *severities,
        *categories,
        F.count(F.lit(1)).cast("double").alias("total"),
        present.cast("double").alias("distinct_categories"),
        F.avg("confidence_score").alias("mean_confidence"),
        F.max("confidence_score").alias("max_confidence"),
    )


def threat_vectors(findings: DataFrame, key: str) -> DataFrame:
    """Threat features as one 18-D vector."""
    columns = threat_columns(findings, [key])
    features = [c for c in columns.columns if c != key]
    return columns.select(key, F.array(*features).alias("threat_18d"))


ANOMALY_MEASURES = (
    "mahalanobis_distance", "renyi_entropy_discrete", "renyi_entropy_differential", "anomaly_score",
)


def anomaly_columns(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 16 anomaly features per key: mean, deviation, minimum, maximum of the four measures."""
    features = []
    for measure in ANOMALY_MEASURES:
        features += [
            F.avg(measure).alias(f"{measure}_mean"),
            F.coalesce(F.stddev_pop(measure), F.lit(0.0)).alias(f"{measure}_std"),
            F.min(measure).alias(f"{measure}_min"),
            F.max(measure).alias(f"{measure}_max"),
        ]
    return reports.groupBy(*keys).agg(*features)


def fusion_weights(components: Sequence[Column], base: Sequence[float] = FUSION_WEIGHTS) -> list[Column]:
    """Weights of the present components, normalised to 1; absent (null) components weigh 0."""
    present = [F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in zip(components, base, strict=True)]
    total = sum(present, F.lit(0.0))
    return [F.coalesce(F.try_divide(w, total), F.lit(0.0)) for w in present]


def fused_score(components: Sequence[Column], base: Sequence[float] = FUSION_WEIGHTS) -> Column:
    """Weighted mean of the present components, clamped to [0, 1]."""
    weighted = [w * F.coalesce(c, F.lit(0.0)) for w, c in zip(fusion_weights(components, base), components, strict=True)]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(weighted, F.lit(0.0))))


def fuse(signals: DataFrame, critical: float = 0.7) -> DataFrame:
    """Fused score, tier and weights from ``analyzer_score``, ``validator_score``, ``security_score``."""
    components = [F.col("analyzer_score"), F.col("validator_score"), F.col("security_score")]
    names = ("weight_analyzer", "weight_validator", "weight_security")
    weights = dict(zip(names, fusion_weights(components), strict=True))
    fused = signals.withColumns(weights).withColumn("unified_risk_score", fused_score(components))
    return fused.withColumn("risk_tier", risk_tier(F.col("unified_risk_score"), critical))


def anomaly_counts(reports: DataFrame, file: str) -> DataFrame:
    """Validator signal per file: anomalous functions and mean anomaly score."""
    return reports.groupBy(file).agg(
        F.count_if(scored_anomaly(F.col("anomaly_score"))).alias("structural_anomalies_count"),
        F.avg("anomaly_score").alias("validator_score"),
    )
