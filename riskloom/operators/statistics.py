"""Population statistics of feature vectors: Mahalanobis distance, Rényi entropies, anomaly scores.

Fitting reduces the table to a handful of numbers per dimension; those come to the driver (their
number depends on the vector width only) and scoring is one narrow pass with them as constants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.levels import ANOMALY_Z


@dataclass(frozen=True)
class Population:
    """Mean and spread of a table of vectors."""

    count: int
    mean: tuple[float, ...]
    variance: tuple[float, ...]
    precision: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.mean)


def dimension_stats(vectors: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample variance and count per dimension (and key); combined map-side, width rows per key."""
    exploded = vectors.select(*keys, F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return exploded.groupBy(*keys, "dim").agg(
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.count(x).alias("n")
    )


def _population(rows: Sequence) -> Population:
    count = rows[0].n if rows else 0
    spread = tuple(0.0 if r.variance is None else r.variance for r in rows)
    return Population(count, tuple(r.mean for r in rows), spread)


def fit(vectors: DataFrame, vector: str) -> Population:
    """Per-dimension mean and sample variance of the whole table; as many numbers as a vector has."""
    return _population(dimension_stats(vectors, vector).orderBy("dim").collect())


def fit_with(vectors: DataFrame, vector: str, measure: Column) -> tuple[Population, float | None, float | None]:
    """Population, and mean and sample deviation of one more measure of each row, from one pass."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    longer = vectors.select(F.concat(F.array(measure), doubles).alias("_longer"))
    first, *rows = dimension_stats(longer, "_longer").orderBy("dim").collect() or [None]
    if first is None:
        return _population([]), None, None
    return _population(rows), first.mean, None if first.variance is None else math.sqrt(first.variance)


def _outer_sums(vector: str, mean: np.ndarray):
    """Per partition: the sum of outer products of the centred vectors, one row per matrix row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((mean.size, mean.size))
        for batch in batches:
            if len(batch):
                centred = np.stack(batch[vector].to_numpy()).astype(np.float64) - mean
                total += centred.T @ centred
        yield pd.DataFrame({"row": np.arange(mean.size), "sums": list(total)})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of the partial arrays of one matrix row."""
    return pd.DataFrame({"row": rows["row"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_numpy()), axis=0)]})


def fit_full(vectors: DataFrame, vector: str) -> Population:
    """Population with the pseudo-inverse of its full covariance matrix.

    Tasks reduce their rows to one width x width matrix; matrices are added by (row, column) across
    the cluster, so the driver receives one matrix whatever the table size.
    """
    base = fit(vectors, vector)
    if base.count < 2:
        return Population(base.count, base.mean, base.variance, np.zeros((base.width, base.width)))
    mean = np.array(base.mean)
    partial = vectors.select(vector).mapInPandas(_outer_sums(vector, mean), "row INT, sums ARRAY<DOUBLE>")
    # one array per task and matrix row meets its like; cells are never rows of their own
    totals = partial.groupBy("row").applyInPandas(_added, "row INT, sums ARRAY<DOUBLE>").collect()
    covariance = np.zeros((base.width, base.width))
    for total in totals:
        covariance[total.row] = np.array(total.sums) / (base.count - 1)
    return Population(base.count, base.mean, base.variance, np.linalg.pinv(covariance, hermitian=True))


def covariance_cells(vectors: DataFrame, vector: str) -> DataFrame:
    """(i, j, covariance) of every pair of dimensions; width rows are collected from each task, not cells."""
    base = fit(vectors, vector)
    partial = vectors.select(vector).mapInPandas(_outer_sums(vector, np.array(base.mean)), "row INT, sums ARRAY<DOUBLE>")
    totals = partial.groupBy("row").applyInPandas(_added, "row INT, sums ARRAY<DOUBLE>")
    cells = totals.select(F.col("row").alias("i"), F.posexplode("sums").alias("j", "s"))
    return cells.select("i", "j", F.try_divide(F.col("s"), F.lit(float(base.count - 1))).alias("covariance"))


def mahalanobis_diagonal(vector: Column, population: Population) -> Column:
    """Distance with a diagonal covariance; a dimension without spread contributes nothing."""
    if not population.width:
        return F.lit(0.0)
    means, variances = F.lit(list(population.mean)), F.lit(list(population.variance))
    squares = F.zip_with(vector, means, lambda x, mean: F.pow(x.cast("double") - mean, F.lit(2.0)))
    terms = F.zip_with(squares, variances, lambda square, v: F.when(v > 0, square / v).otherwise(F.lit(0.0)))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda total, term: total + term))


def mahalanobis_full(vector: Column, population: Population) -> Column:
    """Distance with the full precision matrix, batch-wise in numpy."""
    mean, precision = np.array(population.mean), population.precision

    @F.pandas_udf("double")
    def distance(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype="float64")
        centred = np.stack(batch.to_numpy()).astype(np.float64) - mean
        squared = np.einsum("ij,jk,ik->i", centred, precision, centred, optimize=True)
        return pd.Series(np.sqrt(np.maximum(squared, 0.0)))

    return distance(vector)


def renyi_of_probabilities(power_sum: Column, entropy_sum: Column, alpha: float) -> Column:
    """Entropy of order ``alpha`` from ``sum(p^alpha)``, or Shannon's from ``-sum(p ln p)`` at 1."""
    if alpha == 1:
        return entropy_sum
    return F.ln(power_sum) / (1 - alpha)


def _powered(x: Column, alpha: float) -> Column:
    """``x ** alpha``; the usual order 2 as a plain product."""
    return x * x if alpha == 2 else F.pow(x, F.lit(float(alpha)))


def renyi_discrete(
    rows: DataFrame, keys: Sequence[str], category: str, alpha: float = 2.0, shannon: str | None = None
) -> DataFrame:
    """Rényi entropy of a category's distribution per key (and Shannon's, if named): two combinable aggregations."""
    counts = rows.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    # sum(p^a) = sum(n^a) / N^a and -sum(p ln p) = ln N - sum(n ln n) / N need no join back to the total
    n = F.col("n").cast("double")
    total = F.sum(n)
    power = F.sum(_powered(n, alpha)) / _powered(total, alpha)
    first = F.ln(total) - F.sum(n * F.ln(n)) / total
    named = [first.alias(shannon)] if shannon else []
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), renyi_of_probabilities(power, first, alpha).alias("renyi_entropy"), *named
    )


def renyi_of_vector(vector: Column, alpha: float = 2.0) -> Column:
    """Rényi entropy of one vector's absolute values taken as a distribution; 0 for a zero vector."""
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    powers = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + _powered(x, alpha))
    logs = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    entropy = renyi_of_probabilities(powers / _powered(total, alpha), F.ln(total) - logs / total, alpha)
    return F.when(total > 0, entropy).otherwise(F.lit(0.0))


def _gaussian_constant(alpha: float) -> float:
    shape = 1.0 if alpha == 1 else math.log(alpha) / (alpha - 1)
    return 0.5 * (math.log(2 * math.pi) + shape)


def renyi_differential_of_vector(vector: Column, alpha: float = 2.0) -> Column:
    """Gaussian Rényi entropy of one vector's components; null without spread."""
    # running count, mean and squared deviations: one pass, stable
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(seen: Column, value: Column) -> Column:
        off = value.cast("double") - seen["mean"]
        mean = seen["mean"] + off / (seen["n"] + 1)
        squares = seen["m2"] + off * (value.cast("double") - mean)
        return F.struct((seen["n"] + 1).alias("n"), mean.alias("mean"), squares.alias("m2"))

    variance = F.aggregate(vector, start, step, lambda seen: F.try_divide(seen["m2"], seen["n"] - 1))
    return F.when(variance > 0, 0.5 * F.ln(variance) + _gaussian_constant(alpha))


def renyi_gaussian(vectors: DataFrame, keys: Sequence[str], vector: str, alpha: float = 2.0) -> DataFrame:
    """Gaussian Rényi entropy per key with a diagonal covariance; dimensions without spread are left out."""
    spread = dimension_stats(vectors, vector, keys).where("variance > 0")
    return spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dimensions"),
        F.sum(0.5 * F.ln("variance") + _gaussian_constant(alpha)).alias("renyi_entropy"),
    )


def z_score(value: Column, mean: float | None, spread: float | None) -> Column:
    """Population z-score; 0 without spread."""
    if not spread:
        return F.lit(0.0)
    return (value - F.lit(mean)) / F.lit(spread)


def anomaly_score(z: Column) -> Column:
    """Logistic of z around the anomaly gate, so that score >= 0.5 exactly when z >= 1.5."""
    return 1 / (1 + F.exp(F.lit(ANOMALY_Z) - z))


def function_reports(vectors: DataFrame, key: str, vector: str, alpha: float = 2.0) -> DataFrame:
    """Anomaly report of every function vector against its population."""
    entropy = F.col("renyi_entropy_discrete")
    population, mean, spread = fit_with(vectors, vector, renyi_of_vector(F.col(vector), alpha))
    measured = vectors.withColumns(
        {
            "mahalanobis_distance": mahalanobis_diagonal(F.col(vector), population),
            "renyi_entropy_discrete": renyi_of_vector(F.col(vector), alpha),
            "renyi_entropy_differential": renyi_differential_of_vector(F.col(vector), alpha),
        }
    )
    scored = measured.withColumn("renyi_z_score", z_score(entropy, mean, spread))
    return scored.withColumn("anomaly_score", anomaly_score(F.col("renyi_z_score")))
