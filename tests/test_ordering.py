"""Slices give what a plain window gives, and salted joins what plain joins give."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import ordering
from riskloom.operators.findings import RULES


@pytest.fixture(scope="module")
def rows(spark):
    """300 rows, a third of them on one key, one key null, ties in the order column."""
    key = (F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 11))
    return spark.range(300).select(
        F.col("id"), key.alias("k"), (F.col("id") * 37 % 23).alias("t"), (F.col("id") * 1.5).alias("x")
    )


ORDER = ["t", "id"]


def _order():
    return [F.col(c) for c in ORDER]


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_ordinals_by_slices(rows, keys):
    window = Window.partitionBy(*keys).orderBy(*_order())
    plain = rows.withColumn("n", F.row_number().over(window).cast("bigint"))
    _same(plain, ordering.ordinals(rows, keys, _order(), "n"))


@pytest.mark.parametrize("keys", [["k"], []])
def test_previous_by_slices(rows, keys):
    wanted = {"before": "x", "before_id": "id"}
    window = Window.partitionBy(*keys).orderBy(*_order())
    plain = rows.select("*", *[F.lag(source).over(window).alias(new) for new, source in wanted.items()])
    _same(plain, ordering.with_previous(rows, keys, _order(), wanted))


@pytest.mark.parametrize("size", [1, 2, 7])
def test_rolling_by_blocks(rows, size):
    window = Window.partitionBy("k").orderBy(*_order()).rowsBetween(-(size - 1), 0)
    plain = rows.withColumn("r", F.avg("x").over(window))
    cut = ordering.rolling_mean(rows, ["k"], _order(), "x", size, "r", block=8)
    rounded = [df.withColumn("r", F.round("r", 9)) for df in (plain, cut)]
    _same(*rounded)


def test_digest_ordinals_are_dense_and_in_digest_order(rows):
    window = Window.partitionBy("k").orderBy(ordering.digest("id"), "id")
    expected = rows.withColumn("n", F.row_number().over(window))
    _same(expected, ordering.digest_ordinals(rows, ["k"], ["id"], "n"))


def test_digest_sample_is_the_head_of_digest_order(rows):
    window = Window.partitionBy("k").orderBy(ordering.digest("id"), "id")
    expected = rows.withColumn("n", F.row_number().over(window)).where("n <= 4").drop("n")
    _same(expected, ordering.digest_sample(rows, ["k"], ["id"], 4))


def test_salted_join_equals_plain_join(spark, rows):
    one = spark.createDataFrame([(k, f"name{k}") for k in range(20)], "k BIGINT, name STRING")
    many = rows.withColumn("k", F.col("k").cast("bigint"))
    _same(many.join(one, "k"), ordering.join_many_to_one(many, one, "k", ["id"], salts=4))


def test_left_join_keeps_unmatched_rows_once(spark, rows):
    one = spark.createDataFrame([(k, f"name{k}") for k in range(20)], "k BIGINT, name STRING")
    many = rows.withColumn("k", F.col("k").cast("bigint"))
    expected = one.join(many, "k", "left")
    _same(expected, ordering.left_join_many(one, many, "k", ["id"]))


def test_empty_input(spark, rows):
    none = rows.where("id < 0")
    assert ordering.ordinals(none, ["k"], _order()).count() == 0
    one = spark.createDataFrame([(1, "a")], "k BIGINT, name STRING")
    joined = ordering.left_join_many(one, none.withColumn("k", F.col("k").cast("bigint")), "k", ["id"]).collect()
    assert len(joined) == 1 and joined[0].x is None


def test_rules_have_hints_that_cover_their_own_samples():
    samples = {
        "sql-injection": ['query = "SELECT * FROM users WHERE id = " + user_input', 'cursor.execute(f"select {x}")'],
        "path-traversal": ["open(user_input)", "../../etc/passwd"],
        "hardcoded-secret": ['password = "super_secret_key_12345"', "-----BEGIN RSA PRIVATE KEY-----"],
        "dynamic-eval": ["eval(user_input)"],
        "command-injection": ["os.system(user_input)", "run(x, shell=True)"],
        "unsafe-deserialization": ["return pickle.loads(user_input)", "yaml.load (f)"],
        "weak-hash": ["hashlib.MD5(x)"],
        "insecure-transport": ["http://x", "verify = False"],
        "cross-site-scripting": ["<SCRIPT src=a>"],
        "hardcoded-address": ["10.0.0.1"],
    }
    import re

    for category, lines in samples.items():
        for line in lines:
            matching = [r for r in RULES if r.category == category and re.search(r.pattern, line)]
            assert matching, (category, line)
            assert all(not r.hints or any(h in line.lower() for h in r.hints) for r in matching)


def test_repeated_rows_are_not_broadcast_by_the_size_of_one_of_them(spark, tmp_path):
    """A column that seems small enough to broadcast, ``salts`` times over, is not sent through the driver (F1, F2)."""
    path = str(tmp_path / "one")
    spark.range(300_000).withColumnRenamed("id", "k").write.parquet(path)
    one, many = spark.read.parquet(path), spark.range(10_000_000).select("id", (F.col("id") % 9 * 1000).alias("k"))
    joined = ordering.join_many_to_one(many, one, "k", ["id"])
    planned = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in planned and "SortMergeJoin" in planned
    few = many.where("id < 1000")
    _same(few.join(one, "k"), ordering.join_many_to_one(few, one, "k", ["id"]))


@pytest.mark.parametrize("block", [0, 20, 30, 1000])
def test_large_and_small_keys_are_numbered_alike(rows, block):
    """Keys of up to ``block`` rows go by a plain window, the others by slices (F6)."""
    window = Window.partitionBy("k").orderBy(*_order())
    plain = rows.withColumn("n", F.row_number().over(window).cast("bigint"))
    _same(plain, ordering.ordinals(rows, ["k"], _order(), "n", block=block))
    lagged = rows.withColumn("before", F.lag("x").over(window))
    _same(lagged, ordering.with_previous(rows, ["k"], _order(), {"before": "x"}, block=block))


def test_small_keys_are_shuffled_once(rows):
    """The rows are neither sampled for ranges nor sorted twice (F6)."""
    planned = ordering.ordinals(rows, ["k"], _order(), "n")._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange") == 1 and "rangepartitioning" not in planned and "ExistingRDD" not in planned
