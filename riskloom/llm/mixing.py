"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected, on sums over
the table of sources, until the weights' entropy reaches a target share of the greatest possible one, and raised as far as
needed to keep every source within a repetition limit. With weight ``w`` and a budget of ``B`` tokens a source gives ``w * B``
tokens: whole passes over its documents, each in an order of its own, and the first part of one more pass. The sequence is
cut into blocks; each takes from every source its weight's share of the block's tokens, so that any stretch of blocks
has the target mixture.

Only DataFrame functions. A pass is cut into slices of the keyed hash that orders it; running sums are taken within slices
and over slices, so one source may hold any share of the rows. Rows equal in all columns are one entry with a number, and
only rows like the last one of a part pass are counted out, so an id, or none, that stands any number of times overshoots
a budget by one document at most.

Defined cases: tokens are words; null texts have none; a source without tokens has weight 0 and its documents are given
once; a null source is a source of its own; repeated rows are given each on their own; an empty table gives no rows. In
``mixed_documents`` all columns of the input are kept and none is added; columns of maps are not supported, as they cannot
be compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, stored

SLICE_ROWS = 20_000
LOT_ROWS = 4096  # equal rows that are written out together
STEPS_PER_PASS, PASSES = 4, 8  # 32 halvings of the exponent's range, four to a pass over the sources


@dataclass(frozen=True)
class Target:
    """``evenness``: wanted entropy over that of equal weights. ``repetitions``: most passes over any source.

    ``budget``: tokens to give; ``None`` is the least budget that gives every document at least once.
    """

    evenness: float
    repetitions: float
    budget: float | None = None


def identity(docs: DataFrame) -> Column:
    """A hash of all columns; nulls count, too."""
    return F.xxhash64(*[docs[c] for c in docs.columns], *[docs[c].isNull() for c in docs.columns])


def merged(rows: DataFrame) -> DataFrame:
    """Rows of ``(doc_id, source, identity, tokens)`` with ``times``, how often each stands."""
    return rows.groupBy("doc_id", "source", "identity", "tokens").agg(F.count(F.lit(1)).alias("times"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, identity, tokens and times of the different documents."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return merged(docs.select("doc_id", "source", identity(docs).alias("identity"), tokens.alias("tokens")))


def find_exponent(sources: DataFrame, target: Target) -> float:
    """Exponent in [0, 1] for a table of sources with positive ``share`` of the tokens and ``all_tokens``."""
    facts = sources.agg(
        F.count(F.lit(1)).alias("n"), F.min("share").alias("least"), F.max("share").alias("most"), F.max("all_tokens").alias("t")
    ).first()
    if not facts["n"] or facts["n"] == 1:
        return 1.0
    wanted = target.evenness * math.log(facts["n"])

    def bisect(good_below: bool, holds) -> float:
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            grid = [low + (high - low) * i / 2**STEPS_PER_PASS for i in range(1, 2**STEPS_PER_PASS)]
            sums = [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)]
            logs = [F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"e{i}") for i, a in enumerate(grid)]
            row = sources.agg(*sums, *logs).first()
            good = [holds(a, row[f"z{i}"], row[f"e{i}"]) for i, a in enumerate(grid)]
            # the condition holds on one side of a threshold; keep the step around it
            turn = sum(good) if good_below else len(good) - sum(good)
            edges = [low, *grid, high]
            low, high = edges[turn], edges[turn + 1]
        return low if good_below else high

    even = bisect(True, lambda a, z, e: math.log(z) - a * e / z >= wanted)

    def passes(a: float, z: float, _: float) -> bool:
        if target.budget is None:
            return (facts["least"] / facts["most"]) ** (a - 1) <= target.repetitions
        return facts["least"] ** (a - 1) / z * target.budget / facts["t"] <= target.repetitions

    return max(even, bisect(False, passes))


def _key(seed: int, copy: Column) -> Column:
    """Order of a document in a pass."""
    return F.xxhash64(F.lit(seed), copy, F.col("identity"))


def _slice(key: Column, rows: Column) -> Column:
    """Slice of a key: ranges of the hash, about ``SLICE_ROWS`` rows each."""
    unit = (F.shiftright(key, 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    return F.floor(unit * F.ceil(rows / SLICE_ROWS)).cast("bigint")


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def _starts(rows: DataFrame) -> DataFrame:
    """Tokens of the same source and pass before each row of ``(source, copy, key, docs, tokens, times, ...)``."""
    sliced = rows.withColumn("_slice", _slice(F.col("key"), F.col("docs")))
    own = ["source", "copy", "_slice"]
    running = Window.partitionBy(*own).orderBy("key", "doc_id", "identity").rowsBetween(Window.unboundedPreceding, -1)
    amount = F.col("tokens") * F.col("times")
    inside = sliced.withColumn("_inside", F.coalesce(F.sum(amount).over(running), F.lit(0)))
    sums = sliced.groupBy(*own).agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy("source", "copy").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*own, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    same = _same_source(inside, before) & (inside["copy"] == before["copy"]) & (inside["_slice"] == before["_slice"])
    return inside.join(before, same).select(
        *[inside[c] for c in rows.columns], (F.col("_before") + F.col("_inside")).alias("start")
    )


def _written_out(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as it says, with its number ``_o`` among its equals; many equal rows are dealt out in lots."""
    last = F.col(times) - 1
    lots = rows.where(F.col(times) > LOT_ROWS).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / LOT_ROWS))))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = lots.repartition(spread, F.xxhash64(*rows.columns, "_lot"))
    first = F.col("_lot") * LOT_ROWS
    many = lots.withColumn("_o", F.explode(F.sequence(first, F.least(last, first + LOT_ROWS - 1)))).drop("_lot")
    few = rows.where(F.col(times).between(1, LOT_ROWS))
    return few.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).unionByName(many)


def mixing_plan(counted: DataFrame, target: Target, seed: int = 0) -> DataFrame:
    """Per source: docs, source_tokens, share, weight, quota, whole passes, and of the part pass its last key and how many rows of that (or null).

    ``counted`` is a stored result of ``token_counts`` or ``merged``.
    """
    sums = counted.groupBy("source").agg(F.sum("times").alias("docs"), F.sum(F.col("tokens") * F.col("times")).alias("source_tokens"))
    sums = stored(sums, "sources")
    total = sums.agg(F.sum("source_tokens")).first()[0] or 0
    share = F.col("source_tokens") / F.lit(float(max(total, 1)))
    shared = sums.withColumn("share", share).withColumn("all_tokens", F.lit(total))
    spoken = shared.where("share > 0")
    exponent = find_exponent(spoken, target)
    raw = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(F.lit(0.0))
    facts = spoken.agg(F.sum(raw).alias("z"), F.max(F.col("share") / raw).alias("r")).first()
    z = facts["z"] or 1.0
    # the least budget at which no source is cut short: the largest tokens / weight
    budget = target.budget if target.budget is not None else total * (facts["r"] or 0.0) * z
    weight = raw / F.lit(z)
    # a quota within a millionth of whole passes is whole passes
    passes = F.when(F.col("share") > 0, F.col("weight") * F.lit(float(budget)) / F.col("source_tokens")).otherwise(F.lit(1.0))
    whole = F.floor(F.col("_passes") + 1e-6).cast("int")
    plan = shared.withColumn("weight", weight).withColumn("_passes", passes)
    plan = plan.withColumn("whole", whole).withColumn(
        "quota", F.when(F.col("share") > 0, F.col("_passes") * F.col("source_tokens")).otherwise(F.lit(0.0))
    )
    rest = F.greatest(F.lit(0.0), (F.col("_passes") - F.col("whole")) * F.col("source_tokens"))
    plan = stored(plan.withColumn("rest", F.when(F.col("_passes") - F.col("whole") > 1e-6, rest).otherwise(F.lit(0.0))), "plan")

    part = plan.where("rest > 0").select("source", "docs", "whole", "rest")
    met = counted.join(part, _same_source(counted, part)).select(
        counted["source"], "doc_id", "identity", "tokens", "times", "docs", "rest", F.col("whole").alias("copy")
    )
    begun = _starts(met.withColumn("key", _key(seed, F.col("copy")))).where("start < rest")
    room = F.ceil((F.col("rest") - F.col("start")) / F.col("tokens"))
    taken = F.when(F.col("tokens") > 0, F.least("times", room)).otherwise(F.col("times"))
    last = begun.groupBy("source").agg(F.max(F.struct("key", taken.alias("times"))).alias("_last"))
    last = last.select("source", F.col("_last.key").alias("last_key"), F.col("_last.times").alias("last_times"))
    joined = plan.join(last, _same_source(plan, last), "left").select(*[plan[c] for c in plan.columns], "last_key", "last_times")
    return stored(joined.drop("_passes"), "plan-with-keys")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan's columns of their source, prefixed by ``_p_``."""
    own = plan.select(*[F.col(c).alias(f"_p_{c}") for c in plan.columns])
    return rows.join(own, rows["source"].eqNullSafe(own["_p_source"]))


def _passes(keyed) -> Column:
    """Numbers of the passes a row is in: all whole ones, and the part pass if ``keyed`` holds."""
    upto = F.col("_p_whole") + F.when(F.col("_p_last_key").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    numbers = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda c: (c < F.col("_p_whole")) | keyed(c))


def mixed_sequence(counted: DataFrame, plan: DataFrame, block_tokens: int, seed: int = 0) -> DataFrame:
    """doc_id, source, copy, tokens, start (in its source's stream), block and place (order within the block) of the mixture."""
    met = _with_plan(counted, plan).withColumn("copy", F.explode(_passes(lambda c: _key(seed, c) <= F.col("_p_last_key"))))
    met = met.withColumn("key", _key(seed, F.col("copy")))
    cut = (F.col("copy") == F.col("_p_whole")) & (F.col("key") == F.col("_p_last_key"))
    given = met.select(
        "source", "doc_id", "identity", "tokens", "copy", "key", F.col("_p_docs").alias("docs"),
        F.when(cut, F.least("times", "_p_last_times")).otherwise(F.col("times")).alias("times"),
        F.col("_p_source_tokens").alias("_all"), F.col("_p_weight").alias("_weight"),
    )
    each = _written_out(stored(_starts(given), "mixture-starts"), "times")
    started = each.withColumn("start", F.col("copy") * F.col("_all") + F.col("start") + F.col("_o") * F.col("tokens"))
    part = F.col("_weight") * F.lit(float(block_tokens))
    block = F.when(part > 0, F.floor(F.col("start") / part)).otherwise(F.lit(0)).cast("bigint")
    numbered = started.withColumn("block", block)
    place = F.xxhash64(F.lit(seed + 1), "block", "source", "identity", "copy", "_o")
    return numbered.select("doc_id", "source", "copy", "tokens", "start", "block", place.alias("place"))


def mixed_documents(docs: DataFrame, target: Target, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the mixture gives it; no text is shuffled but of a part pass's last rows."""
    plan = mixing_plan(stored(token_counts(docs), "token-counts"), target, seed)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, own, strict=True)], docs["source"], identity(docs).alias("identity"))
    met = _with_plan(named, plan)
    before = met.withColumn("_copy", F.explode(_passes(lambda c: _key(seed, c) < F.col("_p_last_key")))).select(*own)
    last = met.where(_key(seed, F.col("_p_whole")) == F.col("_p_last_key")).groupBy(*own, "_p_last_times").agg(F.count(F.lit(1)).alias("_n"))
    last = last.withColumn("_n", F.least("_n", "_p_last_times"))
    return before.unionByName(_written_out(last, "_n").select(*own)).toDF(*docs.columns)
