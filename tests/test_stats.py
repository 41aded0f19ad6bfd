"""Tail probabilities and tests against published and hand-worked values."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions import tails
from tillroll.functions.tails import chi2_sf, normal_sf, student_t_two_sided
from tillroll.plans import stats


def close(value, rel=1e-10):
    return pytest.approx(value, rel=rel)


def test_normal():
    assert normal_sf(0) == 0.5
    assert normal_sf(1.959963984540054) == close(0.025)
    assert normal_sf(-1) == close(0.8413447460685429)
    assert 1e-67 < normal_sf(17.2) < 1e-65  # no underflow far out


def test_chi_square_tail():
    assert chi2_sf(2.5134, 4) == close(math.exp(-1.2567) * 2.2567)  # closed form
    assert chi2_sf(2.5134, 4) == pytest.approx(0.642245768142147, abs=2e-5)
    assert chi2_sf(3.841458820694124, 1) == close(0.05)
    assert chi2_sf(80, 2) == close(math.exp(-40))
    assert chi2_sf(0, 3) == 1 and chi2_sf(5, 0) == 1


def test_student():
    assert student_t_two_sided(2.2281388519649385, 10) == close(0.05)
    assert student_t_two_sided(1, 1) == close(0.5)
    assert student_t_two_sided(-1.2176, 7000) == pytest.approx(0.22341, abs=2e-5)
    assert student_t_two_sided(0, 5) == close(1)
    assert student_t_two_sided(3, 2) == close(1 - 3 / math.sqrt(11))


@pytest.mark.parametrize("dof", [1e4, 1e6, 1e9, 1.5e11, 1e12])
@pytest.mark.parametrize("t", [0.1, 1.96, 6, 17])
def test_student_at_large_dof(t, dof):
    """Against the expansion of the tail around the normal one, to second order."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = (t**3 + t) / (4 * dof)
    second = (3 * t**7 - 5 * t**5 - 7 * t**3 - 9 * t) / (96 * dof * dof) + 0 * t
    want = 2 * (normal_sf(t) + density * (first + second))
    rel = 1e-9 + 10 * (t**4 / dof) ** 3
    assert student_t_two_sided(t, dof) == pytest.approx(want, rel=min(rel, 1e-2))


def test_student_on_both_sides_of_the_switch():
    for t in (0.5, 2, 8, 20):
        below, above = student_t_two_sided(t, 9_999.9999), student_t_two_sided(t, 10_000)
        assert below == pytest.approx(above, rel=1e-5) and below > above


def test_no_convergence_is_an_error():
    with pytest.raises(ArithmeticError):
        tails._continued_fraction(iter([(0.0, 1.0), (1.0, 1.0), (5.0, 1.0)]))


def _two_samples(spark, a, b):
    return spark.createDataFrame(
        [(Decimal(x), True) for x in a] + [(Decimal(x), False) for x in b],
        "x decimal(18,2), first boolean",
    )


def test_mann_whitney(spark):
    df = _two_samples(spark, [1, 2, 2], [2, 3])
    first = stats.mann_whitney_u(df, "x", F.col("first")).first()
    second = stats.mann_whitney_u(df, "x", ~F.col("first")).first()
    assert (first.u1, second.u1) == (1.0, 5.0)
    assert first.u_p_value == second.u_p_value
    # z by hand: the ties 2, 2, 2 take 24 / 20 from n + 1
    z = (5 - 3 - 0.5) / math.sqrt(3 * 2 / 12 * (6 - 24 / 20))
    assert first.z == close(z)
    assert first.u_p_value == close(2 * normal_sf(z))
    greater = stats.mann_whitney_u(df, "x", ~F.col("first"), "greater").first()
    assert greater.u_p_value == close(normal_sf(z))
    with pytest.raises(ValueError):
        stats.mann_whitney_u(df, "x", F.col("first"), "less")


def test_welch(spark):
    row = stats.welch_t(_two_samples(spark, [1, 2, 3, 4], [2, 4, 6]), "x", F.col("first")).first()
    v1, v2 = 5 / 3 / 4, 4 / 3
    assert row.t_statistic == close((2.5 - 4) / math.sqrt(v1 + v2))
    assert row.df == close((v1 + v2) ** 2 / (v1**2 / 3 + v2**2 / 2))
    assert 0 < row.t_p_value < 1


def test_chi_square(spark):
    df = spark.createDataFrame([("a", 10, 20), ("b", 30, 40)], "c string, x int, y int")
    row = stats.chi_square(df, ["x", "y"]).first()
    # 2x2: continuity correction. n(|ad - bc| - n/2)^2 / product of the margins
    assert row.chi2 == close(100 * (200 - 50) ** 2 / (30 * 70 * 40 * 60))
    assert (row.dof, row.n) == (1, 100)
    three = df.union(spark.createDataFrame([("c", 25, 25)], df.schema))
    row = stats.chi_square(three, ["x", "y"]).first()
    n, total = 150, [(30, (10, 20)), (70, (30, 40)), (50, (25, 25))]
    margins = (65, 85)
    chi2 = sum((o - r * m / n) ** 2 / (r * m / n) for r, os in total for o, m in zip(os, margins))
    assert (row.chi2, row.dof) == (close(chi2), 2)
    never = df.withColumn("y", F.lit(0))
    row = stats.chi_square(never, ["x", "y"]).first()
    assert (row.chi2, row.dof, row.chi2_p_value) == (0, 0, 1)


def test_chi_square_agrees_with_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    table = [("a", 12, 20), ("b", 31, 40), ("c", 25, 19)]
    df = spark.createDataFrame(table, "c string, x int, y int")
    ours = stats.chi_square(df, ["x", "y"]).first()
    raw = [(float(i), float(o)) for i, (_, x, y) in enumerate(table) for o, n in ((0, x), (1, y)) for _ in range(n)]
    vectors = VectorAssembler(inputCols=["f"], outputCol="v").transform(
        spark.createDataFrame(raw, "f double, label double")
    )
    theirs = ChiSquareTest.test(vectors, "v", "label").first()
    assert ours.chi2 == close(theirs.statistics[0])
    assert ours.chi2_p_value == close(theirs.pValues[0], 1e-8)


def test_published_effect_size():
    # the divisor 3 gives the published 0.0145, the textbook one 0.0251
    assert round(math.sqrt(2.5134 / (4000 * 3)), 4) == 0.0145
    assert round(math.sqrt(2.5134 / 4000), 4) == 0.0251


def test_report(spark, sf_dir):
    from tillroll.sources.tpch import load_tpch_tables

    report = stats.test_results_table(load_tpch_tables(spark, sf_dir)).collect()
    assert [r.hypothesis[:2] for r in report] == ["H1", "H2", "H3"]
    for r in report:
        # a sample of one has no variance, hence no p
        p = 1 if r.p_value is None else r.p_value
        assert 0 <= p <= 1
        assert r.verdict.startswith("Statistically" if p < 0.05 else "Not")
        assert r.business_takeaway.endswith(".")


@pytest.mark.parametrize("n", range(1, 9))
def test_exact_mann_whitney_against_enumeration(n):
    for m in range(1, 9):
        counted = [0] * (n * m + 1)
        for chosen in itertools.combinations(range(n + m), n):
            counted[sum(chosen) - n * (n - 1) // 2] += 1
        assert tails.u_ways(n, m) == counted
        total = sum(counted)
        for u in range(n * m + 1):
            assert tails.mann_whitney_exact(u, n, m) == sum(counted[u:]) / total


def test_exact_mann_whitney_of_uneven_samples():
    ways = tails.u_ways(3, 4_000)
    assert sum(ways) == math.comb(4_003, 3) and ways == ways[::-1]


def test_small_samples_are_exact_unless_tied(spark):
    a, b = [1, 5, 9], [2, 3, 4]
    row = stats.mann_whitney_u(_two_samples(spark, a, b), "x", F.col("first"), "greater").first()
    # of the 20 orders 7 have a U of 6 or more
    assert (row.u1, row.exact, row.u_p_value) == (6, True, 7 / 20)
    both = stats.mann_whitney_u(_two_samples(spark, a, b), "x", F.col("first")).first()
    assert both.u_p_value == 14 / 20
    tied = stats.mann_whitney_u(_two_samples(spark, a, [2, 3, 5]), "x", F.col("first")).first()
    assert not tied.exact
    large = stats.mann_whitney_u(_two_samples(spark, range(0, 18, 2), range(1, 19, 2)), "x", F.col("first")).first()
    assert not large.exact and large.u_p_value == close(2 * normal_sf(large.z))


def test_mann_whitney_by_group(spark):
    rng = random.Random(6)
    rows = [(g, Decimal(rng.randrange(10_000)), rng.random() < 0.3) for g in "abc" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, x decimal(18,2), first boolean").repartition(5)
    got = {r.g: r for r in stats.mann_whitney_u(df, "x", F.col("first"), by=("g",)).collect()}
    for g in "abc":
        one = stats.mann_whitney_u(df.where(F.col("g") == g), "x", F.col("first")).first()
        assert got[g].asDict() == {"g": g, **one.asDict()}


@pytest.mark.parametrize("z", [-2.0, 0.0, 3.0, 17.2, 19.9, 20.1, 36.0])
def test_log_normal_tail_where_the_tail_itself_can_be_said(z):
    assert tails.log_normal_sf(z) == pytest.approx(math.log(normal_sf(z)), rel=1e-12, abs=1e-14)


def test_log_tails_below_the_least_double():
    # by the recurrence of the Mills ratio: z between these bounds for any z > 0
    for z in (40.0, 100.0, 1e4):
        density = -z * z / 2 - math.log(math.sqrt(2 * math.pi))
        low, high = z / (z * z + 1), (z * z + 2) / (z * (z * z + 3))
        got, room = tails.log_normal_sf(z), 1e-15 * z * z
        assert density + math.log(low) - room < got < density + math.log(high) + room
    # even degrees of freedom have closed forms
    for x in (50.0, 2_000.0, 9e5):
        assert tails.log_chi2_sf(x, 2) == close(-x / 2, 1e-13)
        assert tails.log_chi2_sf(x, 4) == close(-x / 2 + math.log1p(x / 2), 1e-13)
    # one degree of freedom: the arc tangent
    for t in (5.0, 1e6, 1e150):
        assert tails.log_student_t_two_sided(t, 1) == close(math.log(2 / math.pi * math.atan(1 / t)), 1e-12)
    assert tails.log_student_t_two_sided(20, 5_000) == close(math.log(student_t_two_sided(20, 5_000)), 1e-12)
    assert tails.log_student_t_two_sided(-60, 1e6) == close(tails.log_student_t_two_sided(60, 1e6))
    assert tails.log_student_t_two_sided(300, 1e6) < -745  # below any double's logarithm


def test_welch_of_values_far_from_zero(spark):
    """The spread is a few cents, the mean a million times that."""
    low, high = [10**12 + x for x in (1, 2, 3, 4)], [10**12 + x for x in (2, 4, 6)]
    near = stats.welch_t(_two_samples(spark, [1, 2, 3, 4], [2, 4, 6]), "x", F.col("first")).first()
    far = stats.welch_t(_two_samples(spark, low, high), "x", F.col("first")).first()
    assert (far.t_statistic, far.df) == (near.t_statistic, near.df)
