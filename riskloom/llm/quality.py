"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures are Columns over the text alone; a rule is one row ``(name, measure, low, high)``, and a text keeps a rule when
``low <= measure <= high``. All measures and all rules end up in the same projection: no join, no shuffle, no user function.

Defined cases: null and empty texts have all counts 0 and fail the base rule; a measure whose denominator is 0 is 0; repeated
rows are judged each on its own; columns of the input other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let, words

SYMBOLS = r"[#*$%&|<>]"
# a word with a letter in it; possessive, so that every character is read once
LETTER_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"
# Frequent function words of the languages at hand; a text of running prose has several of them.
STOP_WORDS = (
    "the be to of and that have with is in for it as was on are by this from or an at "
    "le la les de des du et un une en que qui dans pour par sur pas est au "
    "der die das und ein eine zu von mit den dem ist im auf für nicht sich "
    "el los las del y una por con para se no al es lo como su"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie between ``low`` and ``high``; ``None`` is no limit."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


DEFAULT_RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", "symbol_word_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("alphabetic_words", "alphabetic_word_ratio", 0.7, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.3),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    Rule("distinct_words", "distinct_word_ratio", 0.05, None),
)


def repeated_window_words(own: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text.

    Windows are told apart by a 64-bit hash of their words. They are sorted with their places, so equal ones are neighbours; the places of those that have an equal neighbour
    are sorted again, and each adds the words the place before it does not reach.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.when(k == 0, size).otherwise(F.least(F.lit(size), p - F.get(places, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def equal_neighbour(ranked: Column) -> Column:
        def same(k: Column, text: Column) -> Column:
            return F.coalesce(F.get(ranked, k)["t"] == text, F.lit(False))

        twins = F.filter(ranked, lambda x, k: same(k - 1, x["t"]) | same(k + 1, x["t"]))
        return F.when(F.size(twins) == 0, 0).otherwise(let(F.array_sort(F.transform(twins, lambda x: x["i"])), covered))

    def of(w: Column) -> Column:
        count = F.size(w) - (size - 1)
        starts = F.slice(w, 1, F.greatest(count, F.lit(0)))
        windows = F.transform(starts, lambda _, k: F.xxhash64(*[F.get(w, k + i) for i in range(size)]))
        placed = lambda all_windows: F.transform(all_windows, lambda t, k: F.struct(t.alias("t"), k.alias("i")))
        return let(
            windows,
            lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(
                let(F.sort_array(placed(ws)), equal_neighbour)
            ),
        )

    return let(own, of).cast("bigint")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(text: Column) -> dict[str, Column]:
    """Measures of a text that is never null, as Columns over ``_words`` and ``_lines`` (arrays) and the text itself."""
    own, lines = F.col("_words"), F.col("_lines")
    n_words, n_lines = F.size(own).cast("bigint"), F.size(lines).cast("bigint")
    starts_with_bullet = lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•", "‣", "◦")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    word_chars = F.char_length(F.array_join(own, "")).cast("bigint")
    return {
        "n_words": n_words,
        "n_lines": n_lines,
        "word_chars": word_chars,
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_window_words(own),
        "n_stop_words": F.size(F.array_intersect(own, stop)).cast("bigint"),
        "n_alphabetic_words": F.regexp_count(text, F.lit(LETTER_WORD)).cast("bigint"),
        "n_distinct_words": F.size(F.array_distinct(own)).cast("bigint"),
        "n_bullet_lines": F.size(F.filter(lines, starts_with_bullet)).cast("bigint"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint"),
    }


def derived() -> dict[str, Column]:
    """Ratios over the counted measures."""
    c = F.col
    return {
        "mean_word_length": _ratio(c("word_chars"), c("n_words")),
        "symbol_word_ratio": _ratio(c("n_symbols"), c("n_words")),
        "stop_word_ratio": _ratio(c("n_stop_words"), c("n_words")),
        "alphabetic_word_ratio": _ratio(c("n_alphabetic_words"), c("n_words")),
        # the vocabulary of running text grows about as the root of its length
        "distinct_word_ratio": _ratio(c("n_distinct_words"), F.sqrt(c("n_words")) * F.sqrt(F.least(c("n_words"), F.lit(100)))),
        "duplicate_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipsis_lines"), c("n_lines")),
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules a row breaks, in the order of the table."""
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        broken.append(F.when(outside, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """doc_id, all measures, base_failed, failed_rules and kept for every row of ``(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0
    base = docs.select(
        "doc_id",
        text.alias("_text"),
        words(text).alias("_words"),
        F.filter(F.split(text, "\n"), has_word).alias("_lines"),
    )
    counted = base.select("doc_id", *[m.alias(name) for name, m in measures(F.col("_text")).items()])
    rated = counted.select("*", *[m.alias(name) for name, m in derived().items()])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rated.select("*", base_failed.alias("base_failed"), compile_rules(rules).alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
