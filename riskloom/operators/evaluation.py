"""Evaluation of predictions against labels: confusion cells, ratios, folds, bootstrap intervals.

Every measure is a function of four counts, so rows are reduced to counts first and everything after
that works on small aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import digest, digest_ordinals, digest_sample

FOLDS = 5
ITERATIONS = 1_000
CONFIDENCE = 0.95
CELLS = ("tp", "fp", "fn", "tn")


def _poisson_steps(rest: float = 1e-12) -> tuple[float, ...]:
    """Distribution function of Poisson(1) at 0, 1, 2, ..., until less than ``rest`` is left."""
    steps, term, total = [], math.exp(-1), 0.0
    while 1 - total >= rest:
        total += term
        steps.append(total)
        term /= len(steps)
    return tuple(steps)


POISSON_STEPS = _poisson_steps()


def cells(truth: Column, predicted: Column) -> list[Column]:
    """The four confusion counts as aggregates; a missing prediction is no prediction."""
    hit = F.coalesce(predicted, F.lit(False))
    return [
        F.count_if(truth & hit).alias("tp"),
        F.count_if(~truth & hit).alias("fp"),
        F.count_if(truth & ~hit).alias("fn"),
        F.count_if(~truth & ~hit).alias("tn"),
    ]


def ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and accuracy; null where undefined."""
    return {
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
    }


def metrics(rows: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Confusion counts and ratios per key."""
    counted = rows.groupBy(*keys).agg(*cells(F.col(truth), F.col(predicted)))
    return counted.withColumns(ratios(*[F.col(c) for c in CELLS]))


def category_metrics(labelled: DataFrame, hits: DataFrame, key: str, truth: str, category: str) -> DataFrame:
    """Precision and recall of each category taken alone as the flag of a file.

    Files a category misses are never listed: its missed counts are the label totals minus its hits.
    """
    totals = labelled.agg(
        F.count_if(F.col(truth)).alias("positives"), F.count_if(~F.col(truth)).alias("negatives")
    ).first()
    flagged = hits.select(key, category).distinct().join(labelled.select(key, truth), key)
    counted = flagged.groupBy(category).agg(
        F.count_if(F.col(truth)).alias("tp"), F.count_if(~F.col(truth)).alias("fp")
    )
    full = counted.withColumns(
        {"fn": F.lit(totals.positives) - F.col("tp"), "tn": F.lit(totals.negatives) - F.col("fp")}
    )
    return full.withColumns(ratios(*[F.col(c) for c in CELLS]))


def confusion_matrix(rows: DataFrame, tier: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Counts of tier by label."""
    columns = [F.count_if(F.col(label) == name).alias(name.lower()) for name in labels]
    return rows.groupBy(tier).agg(*columns)


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = FOLDS) -> DataFrame:
    """Fold number per row: each label's rows are dealt out in digest order."""
    dealt = digest_ordinals(rows, [label], [key], "_at")
    return dealt.withColumn("fold", ((F.col("_at") - 1) % folds).cast("int")).drop("_at")


def balanced_sample(rows: DataFrame, label: str, key: str, size: int) -> DataFrame:
    """The same number of rows of every label, the first in digest order: ``size``, or what the rarest label has."""
    rarest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return digest_sample(rows, [label], [key], min(size, rarest or 0))


def _uniform(*columns: str) -> Column:
    """A number in [0, 1) from a digest: equal in every engine and on every retry."""
    return F.conv(F.substring(digest(*columns), 1, 12), 16, 10).cast("bigint") / float(1 << 48)


def _poisson_weight(uniform: Column) -> Column:
    weight = F.lit(0)
    for step in POISSON_STEPS:
        weight = weight + F.when(uniform >= step, F.lit(1)).otherwise(F.lit(0))
    return weight


def bootstrap(rows: DataFrame, key: str, truth: str, predicted: str, iterations: int = ITERATIONS) -> DataFrame:
    """Bootstrap intervals of the four ratios.

    Every row has a Poisson(1) weight of its own in every iteration, from a digest of both. The weights are summed
    on the map side, so ``iterations`` rows of four sums leave each task, whatever the size of the table.
    """
    hit = F.coalesce(F.col(predicted), F.lit(False))
    cell = F.when(F.col(truth), F.when(hit, F.lit("tp")).otherwise(F.lit("fn"))).otherwise(
        F.when(hit, F.lit("fp")).otherwise(F.lit("tn"))
    )
    given = rows.where(F.col(truth).isNotNull()).select(F.col(key).alias("_key"), cell.alias("_cell"))
    drawn = given.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    # the draw is a column of its own, so its digest is computed once per row
    weighed = drawn.withColumn("_u", _uniform("_key", "iteration")).withColumn("_w", _poisson_weight(F.col("_u")))
    sums = weighed.groupBy("iteration").agg(
        *[F.sum(F.when(F.col("_cell") == c, F.col("_w")).otherwise(F.lit(0))).alias(c) for c in CELLS]
    )
    measured = ratios(*[F.col(c) for c in CELLS])
    named = F.explode(
        F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in measured.items()])
    )
    values = sums.select(named.alias("m")).select("m.metric", "m.value")
    tail = (1 - CONFIDENCE) / 2
    return values.groupBy("metric").agg(
        F.count("value").alias("iterations"),
        F.avg("value").alias("mean"),
        F.percentile("value", F.lit(tail)).alias("low"),
        F.percentile("value", F.lit(1 - tail)).alias("high"),
    )


def agreement(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How two tools agree over all files either of them saw: ``(first, second, files)``."""
    a = first.select(key, F.col("flagged").alias("a"))
    b = second.select(key, F.col("flagged").alias("b"))
    joined = a.join(b, key, "full_outer").select(
        F.coalesce("a", F.lit(False)).alias("first"), F.coalesce("b", F.lit(False)).alias("second")
    )
    return joined.groupBy("first", "second").agg(F.count(F.lit(1)).alias("files"))
