"""Uniform shuffle of a table into shards of exact sizes, by a communication matrix.

Rows lie in cells (a hash of their identity). Given the exact sizes of cells and shards, the number of rows every cell
sends to every shard is drawn without replacement: a hypergeometric matrix with the given margins, so that the result is
distributed as a uniformly random assignment. A cell then permutes its rows (by a keyed hash) and deals them out by its
row of the matrix, the rows are exchanged, and each shard permutes what it received (by another keyed hash) to number its
slots. Both permutations sort within bounded slices, never a whole shard in one task.

The matrix has ``cells x shards`` numbers with ``MIN_CELLS <= cells <= MAX_CELLS``; it is all the driver holds. Everything else is
DataFrame work.

Defined cases: null ids and null texts are values like any other; rows equal in all columns are merged, dealt in lots of
``LOT_ROWS`` and get slots of their own, so neither an id that stands often nor a repeated row fills a cell; rows of equal
identity go by their other columns, so a repeated task numbers them alike; an empty table gives no rows. Input columns with the names of new columns are replaced.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

MIN_CELLS, MAX_CELLS, CELL_ROWS = 96, 4096, 100_000
LOT_ROWS = 64


def draw_hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Number of good items among ``drawn`` out of ``good + bad``, by inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    rest = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while rest > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            rest -= p_up
            if rest <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            rest -= p_down
            if rest <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(cells: Sequence[int], shards: Sequence[int], seed: int) -> list[list[int]]:
    """Rows each cell sends to each shard; row sums are ``cells``, column sums ``shards``."""
    if sum(cells) != sum(shards):
        raise ValueError("cells and shards must hold the same number of rows")
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in cells:
        row, left, others = [], size, sum(room)
        for i, own in enumerate(room):
            others -= own
            sent = draw_hypergeometric(rng, own, others, left)
            row.append(sent)
            room[i] -= sent
            left -= sent
        matrix.append(row)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, identity: Sequence[str], seed: int = 0, sizes: Sequence[int] | None = None) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard) to every row.

    ``identity`` deals rows to cells and orders them within; it should tell most rows apart. ``sizes`` are the shards' exact row
    counts, even by default.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    # equal rows are merged and dealt in lots, so that one row standing any number of times spreads over the cells
    merged = stored(df.groupBy(*kept).agg(F.count(F.lit(1)).alias("_n")), "merged-rows")
    rows = merged.agg(F.sum("_n")).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, -(-rows // CELL_ROWS)))
    lots = merged.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / LOT_ROWS))))
    lots = lots.withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed), *identity, "_lot"), F.lit(cells)).cast("int"))
    lots = lots.withColumn("_size", F.least(F.col("_n") - F.col("_lot") * LOT_ROWS, F.lit(LOT_ROWS)))
    counted = {r["_cell"]: r["n"] for r in lots.groupBy("_cell").agg(F.sum("_size").alias("n")).collect()}
    numbers = sorted(counted)
    matrix = communication_matrix([counted[c] for c in numbers], list(sizes or even_sizes(rows, shards)), seed)
    bounds = [(c, [sum(row[: i + 1]) for i in range(shards)]) for c, row in zip(numbers, matrix, strict=True)]
    dealt = spark.createDataFrame(bounds, "_cell int, _bounds array<bigint>")

    # lots travel to their cell whole and become rows there
    number = F.explode(F.sequence(F.col("_lot") * LOT_ROWS, F.col("_lot") * LOT_ROWS + F.col("_size") - 1))
    tagged = lots.repartition("_cell").withColumn("_copy", number)
    told = [*identity, "_copy", *[c for c in kept if c not in identity]]
    tagged = tagged.select(*kept, "_copy", "_cell", F.xxhash64(F.lit(seed + 1), *identity, "_copy").alias("_order"))
    within = Window.partitionBy("_cell").orderBy("_order", *told)
    ranked = tagged.withColumn("_rank", F.row_number().over(within) - 1).join(dealt, "_cell")
    sent = ranked.select(
        *kept,
        "_copy",
        F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))).alias("shard"),
        F.xxhash64(F.lit(seed + 2), *identity, "_copy").alias("_order"),
    )
    # the second permutation, slice by slice: a slice is a range of the keyed hash
    sent = sent.withColumn("_slice", F.floor((F.shiftright("_order", 32) + F.lit(1 << 31)) * cells / F.lit(1 << 32)).cast("int"))
    sliced = Window.partitionBy("shard", "_slice").orderBy("_order", *told)
    numbered = sent.withColumn("_place", F.row_number().over(sliced) - 1)
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes_of = sent.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes_of.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.join(offsets, ["shard", "_slice"])
    return placed.select(*kept, "shard", (F.col("_before") + F.col("_place")).alias("slot"))
