"""Hypothesis tests on executors' sums; only one-row frames carry the formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.functions.exact import mean, pct
from tillroll.functions.tails import (
    chi2_sf_udf,
    log10_chi2_udf,
    log10_normal_udf,
    log10_student_udf,
    mann_whitney_exact_udf,
    normal_sf_udf,
    student_t_two_sided_udf,
)
from tillroll.operators.ranks import power_sums, rank_sums
from tillroll.sources.schemas import COMPLETED
from tillroll.sources.stored import StoredOrders
from tillroll.sources.tables import ORDER_OF_SEQUENCE, RetailTables

ALPHA = 0.05
# Without ties, a sample of up to EXACT_SIZE gets its p from all orders of the two samples,
# as long as these have up to EXACT_PRODUCT values of U; else the normal approximation.
EXACT_SIZE, EXACT_PRODUCT = 8, 200_000


def _d(name: str) -> Column:
    return F.col(name).cast("double")


# an empty or constant sample gives NULL, not an error
_div = F.try_divide


# -- generic tests: each adds its result to a one-row frame of sums ---------------------


def _squared_deviations(i: int) -> Column:
    """Sum of squared deviations of a sample from its mean.

    The squares are first shifted to the mean in whole cents, on exact decimals: the sum
    may be tiny beside q. What the shift leaves is subtracted in doubles.
    """
    n, s, q = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"q{i}")
    centre = _div(s, n).try_cast("decimal(18,2)")
    total = s.try_cast("decimal(20,2)")
    twice = F.try_multiply(centre * F.lit(2).cast("decimal(1,0)"), total)
    shifted = q - twice + F.try_multiply(centre * centre, n.cast("decimal(11,0)"))
    left = (total - centre * n.cast("decimal(11,0)")).cast("double")
    exact = shifted.cast("double") - _div(left * left, n.cast("double"))
    plain = _d(f"q{i}") - _div(_d(f"s{i}") * _d(f"s{i}"), _d(f"n{i}"))
    return F.coalesce(exact, plain)


def _add_welch(sums: DataFrame, with_p: bool) -> DataFrame:
    for i in (1, 2):
        n, total = _d(f"n{i}"), _d(f"s{i}")
        variance = _div(_squared_deviations(i), n - 1)
        sums = sums.withColumns({f"mean{i}": _div(total, n), f"_e{i}": _div(variance, n)})
    e1, e2 = F.col("_e1"), F.col("_e2")
    spread = _div(e1 * e1, _d("n1") - 1) + _div(e2 * e2, _d("n2") - 1)
    sums = sums.withColumns(
        {
            "t_statistic": _div(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)),
            "df": _div((e1 + e2) * (e1 + e2), spread),
        }
    ).drop("_e1", "_e2")
    if with_p:
        sums = sums.withColumns(
            {
                "t_p_value": student_t_two_sided_udf("t_statistic", "df"),
                "t_log10_p": log10_student_udf("t_statistic", "df"),
            }
        )
    return sums


def _add_mann_whitney(sums: DataFrame, alternative: str, with_p: bool, exact: bool = True) -> DataFrame:
    if alternative not in ("two-sided", "greater"):
        raise ValueError(f"alternative {alternative!r}")
    n1, n2, n = _d("n1"), _d("n2"), _d("n1") + _d("n2")
    u = F.col("u1")
    if alternative == "two-sided":
        u = F.greatest(u, n1 * n2 - u)
    ties = _div(F.col("tie_term"), n * (n - 1))
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - ties))
    sums = sums.withColumn("z", _div(u - n1 * n2 / 2 - 0.5, spread))
    if with_p:
        small = (F.least(n1, n2).between(1, EXACT_SIZE)) & (n1 * n2 <= EXACT_PRODUCT)
        small = F.lit(exact) & small & (F.col("tie_term") == 0)
        sums = sums.withColumn("exact", F.coalesce(small, F.lit(False)))
        counted = mann_whitney_exact_udf(F.when(F.col("exact"), u), n1, n2)
        tail = F.coalesce(counted, normal_sf_udf("z"))
        log10 = F.coalesce(F.log10(counted), log10_normal_udf("z", F.lit(0.0)))
        if alternative == "two-sided":
            tail = F.least(tail * 2, F.lit(1.0))
            log10 = F.least(log10 + math.log10(2), F.lit(0.0))
        sums = sums.withColumns({"u_p_value": tail, "u_log10_p": log10})
    return sums


def welch_t(df: DataFrame, value: str, in_first: Column, with_p: bool = True) -> DataFrame:
    """One row: ``n1, mean1, n2, mean2, t_statistic, df`` (and ``t_p_value``)."""
    out = _add_welch(power_sums(df, value, in_first), with_p)
    return out.select(
        "n1", "mean1", "n2", "mean2", "t_statistic", "df", *(["t_p_value"] if with_p else [])
    )


def mann_whitney_u(
    df: DataFrame,
    value: str,
    in_first: Column,
    alternative: str = "two-sided",
    with_p: bool = True,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row, or one per ``by`` group: ``n1, n2, u1, z`` (and ``u_p_value``, ``exact``).

    Small samples without ties get the exact p (see ``EXACT_SIZE``), others the normal
    approximation with tie and continuity correction. ``alternative`` is 'two-sided' or
    'greater' (the first sample tends to be larger).
    """
    out = _add_mann_whitney(rank_sums(df, value, in_first, by=tuple(by)), alternative, with_p)
    return out.select(*by, "n1", "n2", "u1", "z", *(["u_p_value", "exact"] if with_p else []))


def chi_square(
    table: DataFrame,
    columns: list[str],
    with_p: bool = True,
    extra: list[Column] | None = None,
) -> DataFrame:
    """Independence test of a contingency table, one row per category, one column
    per outcome. One row: ``chi2, dof, n`` (and ``chi2_p_value``), with any ``extra``
    aggregates over the table.

    Outcomes that never occur are left out; one degree of freedom takes the
    continuity correction.
    """
    everything = W.partitionBy()  # over one row per category
    row = sum((_d(c) for c in columns[1:]), _d(columns[0]))
    totals = {f"_t_{c}": F.sum(_d(c)).over(everything) for c in columns}
    filled = table.withColumns(totals).withColumn("_row", row)
    seen = sum((F.when(F.col(f"_t_{c}") > 0, 1).otherwise(0) for c in columns), F.lit(0))
    n = sum((F.col(f"_t_{c}") for c in columns[1:]), F.col(f"_t_{columns[0]}"))
    filled = filled.withColumns(
        {"_n": n, "_dof": (F.count("*").over(everything) - 1) * (seen - 1)}
    )

    def cell(c):
        expected = _div(F.col("_row") * F.col(f"_t_{c}"), F.col("_n"))
        off = F.abs(_d(c) - expected)
        off = F.when(F.col("_dof") == 1, off - F.least(off, F.lit(0.5))).otherwise(off)
        return F.when(expected > 0, off * off / expected).otherwise(0.0)

    cells = sum((cell(c) for c in columns[1:]), cell(columns[0]))
    out = filled.agg(
        F.sum(cells).alias("chi2"),
        F.max("_dof").cast("int").alias("dof"),
        F.max("_n").cast("bigint").alias("n"),
        F.count("*").alias("categories"),
        F.max(seen).alias("outcomes"),
        *(extra or []),
    )
    if with_p:
        out = out.withColumns(
            {
                "chi2_p_value": chi2_sf_udf("chi2", _d("dof")),
                "chi2_log10_p": log10_chi2_udf("chi2", _d("dof")),
            }
        )
    return out


# -- H1: discount and order value ------------------------------------------------------


def _discounted() -> Column:
    return F.coalesce(F.col("discount_amount") > 0, F.lit(False))


def h1_discount_effect(t: RetailTables, with_p: bool = False, exact: bool = True) -> DataFrame:
    """Order value and margin of discounted (1) against full-price (2) orders. ``exact``:
    whether a small sample may get its p from all orders of the samples."""
    disc = _discounted()
    profit = F.col("gross_profit")
    sums = rank_sums(
        t.completed(),
        "total_amount",
        disc,
        extra={"profit1": F.when(disc, profit), "profit2": F.when(~disc, profit)},
    )
    tested = _add_mann_whitney(_add_welch(sums, with_p), "two-sided", with_p, exact)
    mean1, mean2 = F.col("mean1"), F.col("mean2")
    return tested.select(
        F.col("n1").alias("discounted_orders"),
        F.col("n2").alias("full_price_orders"),
        mean(F.col("s1"), F.col("n1"), 2).alias("discounted_aov"),
        mean(F.col("s2"), F.col("n2"), 2).alias("full_price_aov"),
        pct(F.col("profit1"), F.col("s1"), 1).alias("discounted_margin_pct"),
        pct(F.col("profit2"), F.col("s2"), 1).alias("full_price_margin_pct"),
        F.round(_div(mean1 - mean2, mean2) * 100, 2).alias("aov_lift_pct"),
        F.round("t_statistic", 4).alias("t_statistic"),
        F.round("df", 4).alias("df"),
        F.col("u1").alias("u_statistic"),
        *(["t_p_value", "u_p_value", "t_log10_p", "u_log10_p"] if with_p else []),
    )


# -- H2: channel and repeat purchase ----------------------------------------------------


def h2_channel_contingency(t: RetailTables) -> DataFrame:
    """Customers per channel by repeat purchase; no completed order counts as none.

    The status is part of the join, not a filter after it, so such customers stay.
    """
    orders = t.completed().groupBy("customer_id").agg(F.count("*").alias("n"))
    repeat = F.coalesce(F.col("n"), F.lit(0)) > 1
    return (
        t.customer_attributes.select("customer_id", "acquisition_channel")
        .join(orders, "customer_id", "left")
        .where(F.col("acquisition_channel").isNotNull())
        .groupBy("acquisition_channel")
        .agg(
            F.count_if(~repeat).alias("single_order"),
            F.count_if(repeat).alias("repeat_buyer"),
            F.count("*").alias("total"),
        )
        .withColumn("repeat_rate_pct", pct(F.col("repeat_buyer"), F.col("total"), 2))
        .orderBy("acquisition_channel")
    )


# Fixed value: columns of the printed contingency table, which the published effect
# size counts in place of the outcomes.
_PRINTED_COLUMNS = 4


def h2_chi_square(t: RetailTables, with_p: bool = False) -> DataFrame:
    table = h2_channel_contingency(t)
    rate, label = F.col("repeat_rate_pct"), F.col("acquisition_channel")
    test = chi_square(
        table,
        ["single_order", "repeat_buyer"],
        with_p,
        extra=[
            F.min_by(label, F.struct(-rate, label)).alias("best_channel"),
            F.max(rate).alias("best_rate_pct"),
            F.min_by(label, F.struct(rate, label)).alias("worst_channel"),
            F.min(rate).alias("worst_rate_pct"),
        ],
    )

    def effect(columns):
        smaller = F.least(F.col("categories").cast("int"), columns) - 1
        return F.round(F.sqrt(_div(F.col("chi2"), _d("n") * smaller)), 4)

    return test.select(
        F.round("chi2", 4).alias("chi2"),
        "dof",
        "n",
        effect(F.col("outcomes")).alias("cramers_v"),
        effect(F.lit(_PRINTED_COLUMNS)).alias("cramers_v_as_published"),
        "best_channel",
        "best_rate_pct",
        "worst_channel",
        "worst_rate_pct",
        *(["chi2_p_value", "chi2_log10_p"] if with_p else []),
    )


# -- H3: first basket and lifetime value -------------------------------------------------


def _first_baskets(t: RetailTables) -> DataFrame:
    """``customer_id, is_multi, lifetime_spend`` of customers whose first order was completed.

    The first order (the smallest by position) and the spend of a customer come from
    one map-side combined pass over the orders.
    """
    completed = F.col("order_status") == COMPLETED
    position = ["order_sequence", "order_id"] if t.has_sequence else ORDER_OF_SEQUENCE
    per_customer = t.orders.groupBy("customer_id").agg(
        F.min(F.struct(*position, "order_status", *t.order_line_count)).alias("first"),
        F.sum(F.when(completed, F.col("total_amount"))).alias("lifetime_spend"),
    )
    if t.has_sequence:
        # a stored sequence may begin later than 1
        per_customer = per_customer.where(F.col("first.order_sequence") == 1)
    first = per_customer.select("customer_id", "first.*", "lifetime_spend").where(completed)
    if not t.order_line_count:
        first = first.join(t.line_counts(), "order_id")
    return first.select("customer_id", (F.col("line_count") > 1).alias("is_multi"), "lifetime_spend")


def h3_first_basket_ltv(t: RetailTables, with_p: bool = False, exact: bool = True) -> DataFrame:
    """Lifetime spend after a multi-item (1) against a single-item (2) first basket."""
    sums = rank_sums(_first_baskets(t), "lifetime_spend", F.col("is_multi"))
    tested = _add_mann_whitney(sums, "greater", with_p, exact)
    mean1, mean2 = _div(_d("s1"), _d("n1")), _div(_d("s2"), _d("n2"))
    lift = _div(mean1 - mean2, mean2) * 100
    return tested.select(
        F.col("n1").alias("multi_customers"),
        F.col("n2").alias("single_customers"),
        mean(F.col("s1"), F.col("n1")).alias("multi_mean_ltv"),
        mean(F.col("s2"), F.col("n2")).alias("single_mean_ltv"),
        F.round(lift, 2).alias("ltv_lift_pct"),
        F.round("u1", 2).alias("u_statistic"),
        *(["u_p_value", "u_log10_p", lift.alias("ltv_lift_unrounded")] if with_p else []),
    )


def h3_by_customer_group(
    t: RetailTables, by: tuple[str, ...] = ("region", "acquisition_channel"), dp: int = 9
) -> DataFrame:
    """The third test within each group of customers, exact where a group is small."""
    customers = t.customer_attributes.select("customer_id", *by)
    spend = _first_baskets(t).join(customers, "customer_id")
    tested = mann_whitney_u(spend, "lifetime_spend", F.col("is_multi"), "greater", by=by)
    return tested.select(
        *by,
        F.col("n1").alias("multi_customers"),
        F.col("n2").alias("single_customers"),
        F.col("u1").alias("u_statistic"),
        "exact",
        F.round("u_p_value", dp).alias("p_value"),
    ).orderBy(*by)


# -- summary -------------------------------------------------------------------------


def _verdict(p: Column, alpha: float) -> Column:
    return F.when(
        p < alpha, F.lit(f"Statistically Significant (p < {alpha})")
    ).otherwise(F.lit(f"Not Statistically Significant (p >= {alpha})"))


def _result(df, hypothesis, test_type, statistic, p, takeaway, alpha):
    return df.select(
        F.lit(hypothesis).alias("hypothesis"),
        F.lit(test_type).alias("test_type"),
        F.col(statistic).alias("statistic"),
        F.col(p).alias("p_value"),
        _verdict(F.col(p), alpha).alias("verdict"),
        takeaway.alias("business_takeaway"),
    )


def significant(value: Column, digits: int) -> Column:
    """A double rounded to so many significant digits."""
    text = F.format_string(f"%.{digits - 1}e", value)
    return F.when(value.isNotNull(), text.try_cast("double"))


def test_results_table(
    t: RetailTables, alpha: float = ALPHA, digits: int | None = None
) -> DataFrame:
    """The three tests as one report, from orders that are derived once. ``digits`` rounds
    the p values to so many significant digits."""
    t = StoredOrders(t)
    # The texts of the report.
    h1 = _result(
        h1_discount_effect(t, with_p=True),
        "H1: Promotional Discounts lift AOV",
        "Welch's Two-Sample t-test",
        "t_statistic",
        "t_p_value",
        F.format_string(
            "Discounted orders average $%.2f vs $%.2f (margin changes from %.1f%% to %.1f%%).",
            "discounted_aov",
            "full_price_aov",
            "full_price_margin_pct",
            "discounted_margin_pct",
        ),
        alpha,
    )
    h2 = _result(
        h2_chi_square(t, with_p=True),
        "H2: Channel affects Repeat Rate",
        "Chi-Square Test of Independence",
        "chi2",
        "chi2_p_value",
        F.concat(
            F.lit("Highest repeat rate is "),
            "best_channel",
            F.lit(" ("),
            F.col("best_rate_pct").cast("string"),
            F.lit("%), lowest is "),
            "worst_channel",
            F.lit(" ("),
            F.col("worst_rate_pct").cast("string"),
            F.lit("%)."),
        ),
        alpha,
    )
    h3 = _result(
        h3_first_basket_ltv(t, with_p=True),
        "H3: Multi-Item First Order boosts LTV",
        "Mann-Whitney U Test (One-Tailed)",
        "u_statistic",
        "u_p_value",
        F.format_string(
            "Customers starting with 2+ items generate $%.2f LTV vs $%.2f (%+.1f%% lift).",
            "multi_mean_ltv",
            "single_mean_ltv",
            "ltv_lift_unrounded",
        ),
        alpha,
    )
    report = h1.unionByName(h2).unionByName(h3)
    if digits is None:
        return report
    return report.withColumn("p_value", significant(F.col("p_value"), digits))


def hypothesis_log10_p(t: RetailTables, dp: int = 8) -> DataFrame:
    """log10 of the four p-values by normal approximation, rounded: far tails keep their
    digits."""
    return _four_tests(t, "log10_p", dp)


def hypothesis_p_values(t: RetailTables, dp: int = 6) -> DataFrame:
    """The four p-values, by normal approximation where there is a choice, rounded."""
    return _four_tests(t, "p_value", dp)


def _four_tests(t: RetailTables, what: str, dp: int) -> DataFrame:
    t = StoredOrders(t)
    h1 = h1_discount_effect(t, with_p=True, exact=False)
    h2 = h2_chi_square(t, with_p=True)
    h3 = h3_first_basket_ltv(t, with_p=True, exact=False)

    def row(df, *tests):
        return df.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(test).alias("test"), F.round(f"{p}_{what}", dp).alias(what))
                        for test, p in tests
                    ]
                )
            )
        )

    return (
        row(h1, ("H1 Welch t", "t"), ("H1 Mann-Whitney U", "u"))
        .unionByName(row(h2, ("H2 chi-square", "chi2")))
        .unionByName(row(h3, ("H3 Mann-Whitney U, greater", "u")))
    )


test_results_table.__test__ = False  # not a pytest case
