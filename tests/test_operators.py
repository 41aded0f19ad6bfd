"""Skew-safe operators against the plain Spark forms."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import Window as W, functions as F

from fixtures import rows
from tillroll.functions.exact import mean, pct
from tillroll.operators import ranks, skew
from tillroll.operators.scan import ordered_scan
from tillroll.operators.scratch import materialize, scratch_root
from tillroll.operators.skew import HotKeys, hot_keys, salted_join, with_group_values
from tillroll.operators.tiles import add_ntiles, tile_ends


@pytest.mark.parametrize("share", [4_000, 10_000])
def test_hot_keys_of_any_share(spark, monkeypatch, share):
    """Many equal heavy keys, each a small share of the rows, are all found."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 60)
    per_key, n_hot = 100, 200
    heavy = spark.range(n_hot * per_key).select((F.col("id") % n_hot).alias("k"))
    light = spark.range(share * per_key - n_hot * per_key).select((F.col("id") + 1_000_000).alias("k"))
    (hot,) = hot_keys(heavy.unionByName(light), "k")
    assert set(range(n_hot)) <= set(hot.counts)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to key 0; many ties in day."""
    rng = random.Random(1)
    data = [
        (0 if i % 3 == 0 else rng.randrange(1, 60), rng.randrange(12), i,
         None if rng.random() < 0.3 else Decimal(rng.randrange(10_000)) / 100)
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "k int, day int, id int, x decimal(18,2)").repartition(5)


def test_hot_keys(skewed, monkeypatch):
    assert not hot_keys(skewed, "k")[0]  # small enough for any task
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 500)
    (hot,) = hot_keys(skewed, "k")
    assert set(hot.counts) == {0}
    both = hot_keys(skewed, "k", "id")
    assert [set(h.counts) for h in both] == [{0}, set()]
    text = skewed.select(F.when(F.col("k") > 30, F.concat(F.lit("c"), "k")).alias("k"))
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 20)
    (hot,) = hot_keys(text, "k")  # missing keys are never hot
    assert hot and all(k.startswith("c") for k in hot.counts)


@pytest.mark.parametrize("hot", [HotKeys({0: 1000}), HotKeys({0: 1000, 7: 30, 99: 1})])
def test_ordered_scan_of_hot_keys(skewed, hot, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 150)
    spec = dict(
        count="n", sums={"s": F.col("x")}, prev_max={"p": F.col("x"), "d": F.col("day")}
    )
    plain = ordered_scan(skewed, "k", ["day", "id"], HotKeys(), **spec)
    sliced = ordered_scan(skewed, "k", ["day", "id"], hot, **spec)
    assert sliced.schema == plain.schema
    assert sorted(map(str, rows(sliced))) == sorted(map(str, rows(plain)))
    one_customer = [r for r in rows(plain) if r[0] == 0]
    assert sorted(r[4] for r in one_customer) == list(range(1, 1001))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(skewed, spark, how, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 150)
    keys = spark.range(0, 50, 2).select(F.col("id").cast("int").alias("k"))
    if how != "left_semi":
        keys = keys.withColumn("name", F.concat(F.lit("k"), "k"))
    plain = skewed.join(keys, "k", how)
    salted = salted_join(skewed, keys, "k", HotKeys({0: 1000}), ["id"], how)
    assert sorted(map(str, rows(salted.select(plain.columns)))) == sorted(map(str, rows(plain)))


def test_group_values(skewed):
    values = {"total": F.sum("x"), "n": F.count("*"), "last": F.max("day")}
    plain = with_group_values(skewed, "k", HotKeys(), values)
    hot = with_group_values(skewed, "k", HotKeys({0: 1000}), values)
    assert sorted(map(str, rows(hot))) == sorted(map(str, rows(plain)))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 23, 1003])
@pytest.mark.parametrize("rows_per_task", [10**6, 100])
def test_ntiles(spark, n, rows_per_task, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", rows_per_task)
    rng = random.Random(n)
    data = [(f"c{i:05d}", rng.randrange(4), Decimal(rng.randrange(10**6)) / 100) for i in range(n)]
    df = materialize(spark.createDataFrame(data, "id string, a int, b decimal(18,2)"), "t")
    got = add_ntiles(
        df, n, "id", {"ta": -F.col("a"), "tb": F.col("b")}, 5
    ).withColumns(
        {
            "ea": F.ntile(5).over(W.orderBy(F.desc("a"), "id")),
            "eb": F.ntile(5).over(W.orderBy("b", "id")),
        }
    )
    assert got.where("ta <> ea or tb <> eb").count() == 0
    sizes = [r["count"] for r in got.groupBy("ta").count().collect()]
    assert n == 0 or (sum(sizes) == n and max(sizes) - min(sizes) <= 1)


def test_tile_ends():
    assert tile_ends(3, 5) == [1, 2, 3, 3]
    assert tile_ends(12, 5) == [3, 6, 8, 10]


def test_rank_sums_against_pairs(spark):
    rng = random.Random(3)
    a = [rng.randrange(30) for _ in range(150)]
    b = [rng.randrange(10, 40) for _ in range(90)]
    df = spark.createDataFrame(
        [(Decimal(x), True) for x in a] + [(Decimal(x), False) for x in b],
        "x decimal(18,2), first boolean",
    )
    got = ranks.rank_sums(df, "x", F.col("first"), {"one": F.lit(1)}).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = {v: (a + b).count(v) for v in a + b}
    assert (got.n1, got.n2, got.u1, got.one) != (None,) * 4
    assert (got.n1, got.n2, got.u1) == (150, 90, u)
    assert got.tie_term == sum(t**3 - t for t in ties.values())
    assert (got.s1, got.q2) == (sum(a), sum(y * y for y in b))
    power = ranks.power_sums(df, "x", F.col("first")).first()
    assert [power[c] for c in ("n1", "s1", "q1", "n2", "s2", "q2")] == [
        got[c] for c in ("n1", "s1", "q1", "n2", "s2", "q2")
    ]


def test_exact_rounding(spark):
    df = spark.createDataFrame(
        [(1, 3), (2, 3), (-1, 3), (1, 8), (-1, 8), (5, 0), (0, 4)], "n int, d int"
    )
    got = rows(df.select(pct(F.col("n"), F.col("d"), 2), mean(F.col("n"), F.col("d"), 2)))
    assert got == [
        (33.33, 0.33), (66.67, 0.67), (-33.33, -0.33), (12.5, 0.13), (-12.5, -0.13),
        (None, None), (0.0, 0.0),
    ]
    money = spark.sql("select cast(2.01 as decimal(28,2)) a, cast(2 as bigint) n")
    assert rows(money.select(mean(F.col("a"), F.col("n")))) == [(1.01,)]  # 1.005


def test_ratios_against_fractions(spark):
    rng = random.Random(9)
    amounts = [
        (Decimal(rng.randrange(-10**12, 10**12)) / 100, rng.randrange(1, 10**7))
        for _ in range(500)
    ]
    df = spark.createDataFrame(amounts, "x decimal(28,2), n bigint")
    got = rows(df.select("x", "n", pct(F.col("x"), F.col("n"), 1), mean(F.col("x"), F.col("n"), 2)))

    def half_up(value, dp):
        scaled = abs(value) * 10**dp
        units = int(scaled + Fraction(1, 2))
        return (-units if value < 0 else units) / 10**dp

    for (x, n), (_, _, p, m) in zip(amounts, got):
        assert p == half_up(Fraction(x) / n * 100, 1)
        assert m == half_up(Fraction(x) / n, 2)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    assert scratch_root(spark)

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch_root(Session())
