"""Keyed look-ups: snapshot diff, baselines, upserts, skipping analysed content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text

RULE_SET_VERSION = "1"


def snapshot_diff(baseline: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer diff by key: ``change`` is added, removed, changed or unchanged (nulls equal nulls)."""
    before = baseline.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b"))
    after = current.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_c"))
    change = (
        F.when(F.col("_b").isNull(), F.lit("added"))
        .when(F.col("_c").isNull(), F.lit("removed"))
        .when(F.col("before").eqNullSafe(F.col("after")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    joined = before.join(after, list(keys), "full_outer")
    return joined.select(*keys, "before", "after", change.alias("change"))


def by_name(functions: DataFrame, keys: Sequence[str], key: str, value: str) -> DataFrame:
    """Rows re-keyed by the name part of a function key, so moved code keeps its key (largest value wins)."""
    named = functions.withColumn(key, text.key_name(F.col(key)))
    return named.groupBy(*keys, key).agg(F.max(value).alias(value))


def with_baseline(current: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Every current row with its baseline, null when there is none."""
    return current.join(baselines, key, "left")


def having_baseline(current: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Current rows for which a baseline exists."""
    return current.join(baselines.select(key), key, "left_semi")


def missing_baselines(wanted: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Wanted keys without a baseline."""
    return wanted.join(baselines.select(key), key, "left_anti")


def split_required(records: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records: every required field must be present and not empty or zero."""
    complete = F.lit(True)
    for name in required:
        field = F.col(name)
        empty = F.lit("") if dict(records.dtypes)[name] == "string" else F.lit(0)
        complete = complete & F.coalesce(field != empty, F.lit(False))
    return records.where(complete), records.where(~complete)


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    key: str,
    updated: Sequence[str],
    stamp: Column,
    new: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Target after an upsert by ``key``.

    A match takes the ``updated`` columns and the update stamp and keeps its id and creation moment;
    a new key is inserted with both moments set to ``stamp``. ``new`` gives further columns of inserted rows, such as
    their id, as Columns over ``key``; target columns that nothing names become null there.
    """
    # of several records of one key the one whose updated fields are greatest counts, so a key is written once
    fields = F.struct(*[F.col(c) for c in updated], *[F.col(c) for c in incoming.columns if c not in (key, *updated)])
    once = incoming.groupBy(key).agg(F.max(fields).alias("_r")).select(key, "_r.*")
    once = once.withColumns({f"_new_{name}": value for name, value in (new or {}).items()})
    t, i = target.alias("t"), once.withColumn("_in", F.lit(True)).alias("i")
    joined = t.join(i, F.col(f"t.{key}") == F.col(f"i.{key}"), "full_outer")
    matched = F.col("i._in").isNotNull()
    inserted = F.col(f"t.{key}").isNull()
    columns = []
    for name in target.columns:
        old = F.col(f"t.{name}")
        if name == key:
            columns.append(F.coalesce(old, F.col(f"i.{key}")).alias(name))
        elif name in updated:
            columns.append(F.when(matched, F.col(f"i.{name}")).otherwise(old).alias(name))
        elif name == "updated_at":
            columns.append(F.when(matched, stamp).otherwise(old).alias(name))
        elif name == "created_at":
            columns.append(F.when(inserted, stamp).otherwise(old).alias(name))
        elif new and name in new:
            columns.append(F.when(inserted, F.col(f"_new_{name}")).otherwise(old).alias(name))
        else:
            columns.append(old.alias(name))
    action = F.when(inserted, F.lit("insert")).when(matched, F.lit("update")).otherwise(F.lit("keep"))
    return joined.select(*columns, action.alias("action"))


def latest_per_key(records: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last record of each key by a combinable maximum; the order columns must be unique per key."""
    rest = [c for c in records.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    last = records.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return last.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in records.columns])


def first_marked(comments: DataFrame, pr: str, order: str, body: str, marker: str) -> DataFrame:
    """First comment with the marker of each pull request, by a combinable minimum."""
    marked = comments.where(F.col(body).contains(marker))
    return marked.groupBy(pr).agg(F.min(order).alias(order))


def comment_upsert(comments: DataFrame, posts: DataFrame, pr: str, order: str, body: str, marker: str) -> DataFrame:
    """Comments after posting ``posts (pr, new_body)``: edit the first marked comment, else append one."""
    first = first_marked(comments, pr, order, body, marker).withColumn("_first", F.lit(True))
    edits = first.join(posts.select(pr, "new_body"), pr)
    edited = comments.join(edits, [pr, order], "left")
    kept = edited.select(
        pr,
        order,
        F.coalesce("new_body", F.col(body)).alias(body),
        F.when(F.col("_first"), F.lit("edited")).otherwise(F.lit("kept")).alias("action"),
    )
    last = comments.groupBy(pr).agg(F.max(order).alias("_last"))
    fresh = posts.join(first.select(pr), pr, "left_anti").join(last, pr, "left")
    created = fresh.select(
        pr,
        F.coalesce(F.col("_last") + 1, F.lit(0)).alias(order),
        F.col("new_body").alias(body),
        F.lit("created").alias("action"),
    )
    return kept.unionByName(created)


def content_key(content: Column, rule_set: str = RULE_SET_VERSION) -> Column:
    """Key of an analysis result: same text under same rules gives same result."""
    return F.concat_ws(":", F.lit(rule_set), F.sha2(content, 256))


def unanalysed(
    files: DataFrame, analysed_keys: DataFrame, content: str, rule_set: str = RULE_SET_VERSION
) -> DataFrame:
    """Files whose content has no stored result yet.

    Only keys and the columns asked for afterwards are shuffled. Many copies of one content are
    splittable (an anti join may split its left side), and the stored keys are distinct.
    """
    keyed = files.withColumn("content_key", content_key(F.col(content), rule_set))
    known = analysed_keys.select("content_key").distinct()
    return keyed.join(known, "content_key", "left_anti")
