"""Filter interaction audit: what every order of a set of filters keeps, removes and loses, from one id table per filter.

Each filter's failing ids are a relation of their own. The survivors of a set of filters are the survivors of a smaller set,
left-anti joined with one more relation; so every one of the sets is made once, whatever the number of orders with that
prefix. What a filter removes after a prefix is a left-semi join of its relation with the survivors, and what it would have failed but
is gone already is a left-anti join. An order's rows are looked up by (set of earlier filters, filter).

Rows equal in id, text and part are one unit with a number of rows, found on the map side, so a row that stands a million
times is one entry of the relations.

Defined cases: null texts count as empty; a null language is part ''; several labels of one id count as good or toxic where any is;
rows without an id have no labels and are never the smaller id; rows equal in id and text do not fail the duplicate filter
against each other; an empty table gives no rows. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let, stored
from riskloom.operators.ordering import join_many_to_one

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
MEASURES = ("rows", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a (non-null) text fails each of the filters that look at it alone."""

    def counts(parts: Column) -> Column:
        # only the ends of a split can be empty
        ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
        distinct = F.size(F.array_distinct(parts)) - (ends > 0).cast("int")
        return F.struct((F.size(parts) - ends).alias("words"), distinct.alias("distinct_words"))

    counted = let(F.split(text, SPACES), counts)
    return {
        "counted": counted,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def units(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """unit, part, rows, good, toxic and one boolean per filter: rows of equal id, text and part together."""
    text = F.coalesce("text", F.lit(""))
    failures = text_failures(text)
    facts = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.md5(text).alias("key"),
        failures["counted"].alias("n"), failures["C"].alias("C"), failures["D"].alias("D"),
    ).select(
        "doc_id", "part", "key", (F.col("n.words") < LEAST_WORDS).alias("A"),
        (100 * F.col("n.distinct_words") < LEAST_DISTINCT * F.col("n.words")).alias("B"), "C", "D",
    )
    facts = facts.groupBy("doc_id", "part", "key", "A", "B", "C", "D").agg(F.count(F.lit(1)).alias("rows"))
    facts = stored(facts.withColumn("unit", F.monotonically_increasing_id()), "audit-facts")
    # texts of several ids: rows of all but the smallest one fail
    several = facts.groupBy("key").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"), F.max(F.col("doc_id").isNull()).alias("_none"))
    several = several.where("_least <> _most or (_none and _least is not null)").select("key", "_least")
    copies = join_many_to_one(facts.select("doc_id", "unit", "key"), several, "key", ["unit"])
    failing = copies.where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_least"))).select("unit", F.lit(True).alias("_copy"))
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counts = [(F.col("rows") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    whole = facts.join(rated, "doc_id", "left").select("unit", "part", "rows", *counts, *"ABCD")
    return whole.join(failing, "unit", "left").select("unit", "part", *MEASURES, *"ABCD", F.coalesce("_copy", F.lit(False)).alias("E"))


def _bits(members: Sequence[str]) -> int:
    return sum(1 << FILTERS.index(f) for f in members)


def relations(rated: DataFrame) -> DataFrame:
    """The units that fail each filter ``(filter, unit, part, rows)``, one folder per filter."""
    tables = [stored(rated.where(f).select("unit", "part", "rows"), f"audit-fails-{f}") for f in FILTERS]
    whole = tables[0].select(F.lit(FILTERS[0]).alias("filter"), "unit", "part", "rows")
    for f, one in zip(FILTERS[1:], tables[1:], strict=True):
        whole = whole.unionByName(one.select(F.lit(f).alias("filter"), "unit", "part", "rows"))
    return whole


def _open_filters(before: Column) -> Column:
    """The bits of the filters outside a set."""
    return F.filter(F.array(*[F.lit(_bits(f)) for f in FILTERS]), lambda x: before.bitwiseAND(x) == 0)


def _sets_without(f: str, size: int) -> Column:
    return F.array(*[F.lit(_bits(s)) for s in combinations([x for x in FILTERS if x != f], size)])


def lattice(rated: DataFrame, fails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, steps): per part, what is left after each set of filters, and what each filter finds after each set.

    ``survivors (before, part, rows)``; ``steps (before, filter, part, removed, good, toxic, redundant)``. The sets of one size
    are one table and take three joins, whatever the number of orders. Both sides grow with the documents, so all are sort-merge
    joins: relations that happen to be small are not sent through the driver.
    """
    fails = fails.withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    ids = fails.select("bit", "unit").hint("merge")
    level = rated.select(F.lit(0).alias("before"), "unit", "part", *MEASURES)
    left, found = [], []
    for size in range(len(FILTERS) + 1):
        level = stored(level, f"audit-level-{size}")
        left.append(stored(level.groupBy("before", "part").agg(F.sum("rows").alias("rows")), f"audit-left-{size}"))
        if size == len(FILTERS):
            break
        tried = level.withColumn("f", F.explode(_open_filters(F.col("before")))).select("before", "unit", "part", *MEASURES, F.col("f").alias("bit"))
        removed = tried.join(ids, ["unit", "bit"], "left_semi").groupBy("before", "bit", "part")
        found.append(stored(removed.agg(F.sum("rows").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), f"audit-removed-{size}"))
        if size:
            sets = F.coalesce(*[F.when(F.col("filter") == f, _sets_without(f, size)) for f in FILTERS])
            failing = fails.withColumn("before", F.explode(sets))
            gone = failing.join(level.select("unit", "before").hint("merge"), ["unit", "before"], "left_anti").groupBy("before", "bit", "part")
            found.append(stored(gone.agg(F.sum("rows").alias("redundant")), f"audit-redundant-{size}"))
        # each set is made once: by its last filter
        grown = tried.where(F.col("before") < F.col("bit")).join(ids, ["unit", "bit"], "left_anti")
        level = grown.select(F.col("before").bitwiseOR(F.col("bit")).alias("before"), "unit", "part", *MEASURES)
    survivors, steps = left[0], found[0]
    for one in left[1:]:
        survivors = survivors.unionByName(one)
    for one in found[1:]:
        steps = steps.unionByName(one, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("removed", "good", "toxic", "redundant")]
    steps = steps.withColumn("filter", F.element_at(F.array(*map(F.lit, FILTERS)), F.expr("length(bin(bit))")))
    return survivors, stored(steps.groupBy("before", "filter", "part").agg(*sums), "audit-steps")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    spark = docs.sparkSession
    rated = stored(units(docs, labels), "audit-rated")
    survivors, steps = lattice(rated, relations(rated))
    parts = rated.select("part").distinct()

    # every (set of filters, filter that follows): 80 of them, whatever the table
    pairs = [(_bits(s), f) for f in FILTERS for k in range(len(FILTERS)) for s in combinations([x for x in FILTERS if x != f], k)]
    weights = {(b, f): factorial(b.bit_count()) * factorial(len(FILTERS) - 1 - b.bit_count()) for b, f in pairs}
    entry = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter"), F.lit(b | _bits(f)).alias("after"), F.lit(w).alias("weight")) for (b, f), w in weights.items()]))
    cells = parts.select("part", entry.alias("e")).select("part", "e.*").join(steps, ["part", "before", "filter"], "left")
    remaining = survivors.select("part", F.col("before").alias("after"), F.col("rows").alias("kept"))
    cells = cells.join(remaining, ["part", "after"], "left").na.fill(0, ["removed", "good", "toxic", "redundant", "kept"])
    others = _bits(FILTERS) - F.expr("shiftleft(1, " + f"instr('{FILTERS}', filter) - 1)")
    per_filter = cells.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("weight")).alias("shapley"),
        F.sum(F.when(F.col("before") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    cells = cells.join(per_filter, ["part", "filter"])

    orders = []
    for order in permutations(FILTERS):
        orders += [("".join(order), i + 1, _bits(order[:i]), f) for i, f in enumerate(order)]
    steps_of = spark.createDataFrame(orders, "filter_order string, step int, before int, filter string")
    long = {c: F.col(c).cast("bigint").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    return cells.join(F.broadcast(steps_of), ["before", "filter"]).select(
        "part", "filter_order", "step", long["kept"], long["removed"], long["redundant"], long["unique_fails"],
        F.col("good").cast("bigint").alias("good_lost"), F.col("toxic").cast("bigint").alias("toxic_lost"), long["shapley"],
    )
