"""Hot keys as a table: many of them, joined by broadcast and by shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import rows
from tillroll.operators import skew
from tillroll.operators.scan import ordered_scan
from tillroll.operators.skew import HotKeys, grid_join, hot_keys, salted_join, with_group_values


def _same(a, b):
    assert sorted(map(str, rows(a))) == sorted(map(str, rows(b)))


@pytest.fixture(scope="module")
def many(spark):
    """100,000 keys of three rows and 20,000 of one."""
    heavy = spark.range(300_000).select((F.col("id") % 100_000).alias("k"), "id")
    light = spark.range(20_000).select((F.col("id") + 1_000_000).alias("k"), (F.col("id") + 10**9).alias("id"))
    return heavy.unionByName(light).withColumn("x", F.col("id") % 97)


@pytest.fixture
def many_hot(many, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 2)
    (hot,) = hot_keys(many, "k")
    assert len(hot) == 100_000
    return hot


def test_plans_hold_no_list_of_keys(many, many_hot):
    joined = salted_join(many, many.select("k").distinct(), "k", many_hot, ["id"])
    plan = joined._jdf.queryExecution().toString()
    assert " IN (" not in plan and " INSET " not in plan
    assert len(plan) < 20_000


@pytest.mark.parametrize("limit", [250_000, 1_000])
def test_a_hundred_thousand_hot_keys(many, many_hot, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(skew, "MAX_SLICES", 40)
    keys = many.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    joined = salted_join(many, keys, "k", many_hot, ["id"])
    assert joined.count() == 320_000 and joined.where("name <> concat('n', k)").count() == 0
    scanned = ordered_scan(many, "k", ["id"], many_hot, count="n", sums={"s": F.col("x")})
    plain = ordered_scan(many, "k", ["id"], HotKeys(), count="n", sums={"s": F.col("x")})
    assert scanned.dtypes == plain.dtypes
    assert scanned.exceptAll(plain).count() == 0 and scanned.count() == 320_000
    values = {"total": F.sum("x"), "n": F.count("*")}
    got = with_group_values(many, "k", many_hot, values)
    assert got.exceptAll(with_group_values(many, "k", HotKeys(), values)).count() == 0


@pytest.mark.parametrize("limit", [250_000, 0])
@pytest.mark.parametrize("rows_per_task", [10**6, 400, 9])
def test_grid_join(spark, monkeypatch, rows_per_task, limit):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    left = [(0 if rng.random() < 0.4 else rng.randrange(30), i) for i in range(300)]
    right = [(0 if rng.random() < 0.4 else rng.randrange(40), -i) for i in range(200)]
    a = spark.createDataFrame(left, "k int, a int")
    b = spark.createDataFrame(right + [(None, 5)], "k int, b int")
    _same(grid_join(a, b, "k", ["a"], ["b"]), a.join(b, "k"))


def test_cells_are_no_larger_than_a_task(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    a = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    b = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    joined = grid_join(a, b, "k", ["a"], ["b"])
    cells = [F.pmod(F.xxhash64(c), F.lit(n)) for c, n in (("a", 20), ("b", 30))]
    sizes = joined.groupBy(*cells).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert sizes[0] == 600 and sizes[1] < 500 and sizes[2] == 60_000
