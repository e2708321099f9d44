"""Order-dependent operators that never need a whole group in one task.

A plain ``Window.partitionBy(key)`` sorts each key's rows in a single task. Here rows are range-partitioned on key *and*
order, so a hot key is spread over many slices; work runs within slices, and only one small summary row per slice is
combined across slices. Keys of at most ``BLOCK_ROWS`` rows are bounded groups and need no slices: they are counted first, and
a plain window orders them, with one shuffle instead of three and nothing stored in between.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import settle

SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
BLOCK_ROWS = 1_000_000  # rows of a key, or consecutive ones of a rolling window, that may share one window's partition


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Globally sort by key and order; tag rows with slice number and position, then settle them."""
    mark = F.monotonically_increasing_id()
    ordered = df.orderBy(*[F.col(k) for k in keys], *order).withColumn("_pos", mark)
    return settle(ordered.withColumn("_slice", F.shiftright("_pos", SLICE_BITS)))


def _slice_offsets(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the same key in earlier slices; kept only where a key continues from one slice to the next.

    Sorted slices share at most one key with their predecessor, so this has at most one row per slice.
    """
    runs = sliced.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two DataFrames."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _by_size(df: DataFrame, keys: Sequence[str], block: int, plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` on the keys of at most ``block`` rows, ``sliced`` on the others; without keys all rows are one group."""
    if not keys:
        return sliced(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(counts.where(F.col("_n") > block).select(*[F.col(k).alias(f"_large_{k}") for k in keys]))
    if large.isEmpty():
        return plain(df)
    # one row for every ``block`` rows at most
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_large_{key}"))
    small = df.join(F.broadcast(large), same, "left_anti")
    return plain(small).unionByName(sliced(df.join(F.broadcast(large), same, "left_semi")))


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "ordinal", block: int = BLOCK_ROWS) -> DataFrame:
    """1-based position of each row within its key, in ``order`` (which must be total)."""
    window = Window.partitionBy(*keys).orderBy(*order)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(window).cast("bigint"))

    return _by_size(df, keys, block, plain, lambda rows: _sliced_ordinals(rows, keys, order, out))


def _sliced_ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    sliced = _slices(df, keys, order)
    before = F.broadcast(_slice_offsets(sliced, keys))
    local = Window.partitionBy("_slice", *keys).orderBy("_pos")
    ranked = sliced.withColumn("_rank", F.row_number().over(local))
    joined = ranked.join(before, same_key(ranked, before, ["_slice", *keys]), "left")
    kept = [ranked[c] for c in df.columns]
    return joined.select(*kept, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str], block: int = BLOCK_ROWS
) -> DataFrame:
    """Add, per ``{new: source}`` entry, the value of ``source`` in the previous row of the same key."""
    window = Window.partitionBy(*keys).orderBy(*order)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.lag(source).over(window).alias(new) for new, source in columns.items()])

    return _by_size(df, keys, block, plain, lambda rows: _sliced_previous(rows, keys, order, columns))


def _sliced_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    sliced = _slices(df, keys, order)
    local = Window.partitionBy("_slice", *keys).orderBy("_pos")
    values = F.struct(*[F.col(source).alias(new) for new, source in columns.items()])
    inside = sliced.withColumn("_prev", F.lag(values).over(local))
    tails = sliced.groupBy("_slice", *keys).agg(F.max_by(values, "_pos").alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    # one row per slice boundary a key crosses
    carried = tails.withColumn("_carry", F.lag("_tail").over(across)).where("_carry is not null").drop("_tail")
    joined = inside.join(F.broadcast(carried), same_key(inside, carried, ["_slice", *keys]), "left")
    previous = F.coalesce("_prev", "_carry")
    return joined.select(*[inside[c] for c in df.columns], *[previous[new].alias(new) for new in columns])


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, size: int, out: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Mean of ``column`` over the last ``size`` rows of each key, the current row included.

    Keys are cut into blocks of consecutive rows; each block also receives the ``size - 1`` rows before it, so every
    frame is complete within one block.
    """
    block = max(block, size)
    numbered = ordinals(df, keys, order, "_ord")
    home = F.floor((F.col("_ord") - 1) / block)
    spill = F.floor((F.col("_ord") + (size - 2)) / block)
    blocks = numbered.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, spill)))
    window = Window.partitionBy(*keys, "_block").orderBy("_ord").rowsBetween(-(size - 1), 0)
    framed = blocks.withColumn(out, F.avg(column).over(window)).where("_home = _block")
    return framed.drop("_ord", "_home", "_block")


def digest(*columns: str) -> Column:
    """Hex digest of the given columns: an order that is the same in every engine."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


def digest_ordinals(df: DataFrame, keys: Sequence[str], ids: Sequence[str], out: str = "ordinal") -> DataFrame:
    """1-based position within each key in digest order of a unique id.

    Digest order is uniform, so equal prefix ranges are equal slices: rows are numbered within
    (key, prefix) and shifted by the count of all smaller prefixes of the key (4,096 per key).
    """
    tagged = df.withColumn("_digest", digest(*ids))
    tagged = tagged.withColumn("_prefix", F.substring("_digest", 1, 3))
    earlier = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_prefix").orderBy("_digest", *ids)
    ranked = tagged.withColumn("_rank", F.row_number().over(local))
    joined = ranked.join(shifts, same_key(ranked, shifts, [*keys, "_prefix"]))
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_rank") + F.col("_before")).alias(out))


def digest_sample(df: DataFrame, keys: Sequence[str], ids: Sequence[str], size: int) -> DataFrame:
    """``size`` rows per key: the first in digest order of a unique id (a fair, repeatable sample).

    Each (key, prefix) cell is cut to ``size`` rows before the cells of a key meet, so no task sees
    more than 256 * ``size`` rows of one key.
    """
    tagged = df.withColumn("_digest", digest(*ids)).withColumn("_prefix", F.substring("_digest", 1, 2))
    cell = Window.partitionBy(*keys, "_prefix").orderBy("_digest", *ids)
    cells = tagged.withColumn("_rank", F.row_number().over(cell)).where(F.col("_rank") <= size)
    whole = Window.partitionBy(*keys).orderBy("_digest", *ids)
    kept = cells.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= size)
    return kept.drop("_digest", "_prefix", "_rank")


def join_many_to_one(many: DataFrame, one: DataFrame, key: str, ids: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join on ``key`` where any share of ``many`` may sit on one key of ``one``.

    Every key is split by a hash of ``ids`` into ``salts`` parts, and ``one`` repeated once per part: no count of the keys
    is needed, and a key with a third of the rows meets its partner in ``salts`` tasks, which adaptive skew handling
    splits further. The repeats come from a join with the parts, as the planner counts those and not what ``explode`` adds:
    it must not take ``one`` times ``salts`` for a table small enough to go through the driver.
    """
    part = F.pmod(F.xxhash64(*ids), F.lit(salts))
    salted = many.withColumn("_salt", part)
    repeated = one.crossJoin(F.broadcast(one.sparkSession.range(salts).withColumnRenamed("id", "_salt")))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def left_join_many(one: DataFrame, many: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """``one`` left join ``many`` on ``key``, safe for a hot key on the ``many`` side.

    An outer join cannot split its non-preserved side, so matches and unmatched rows are built apart.
    """
    matched = join_many_to_one(many, one, key, ids)
    unmatched = one.join(many.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
