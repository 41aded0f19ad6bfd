"""Relations between results on the given tables."""

import pytest
from pyspark.sql import functions as F

from tillroll.plans import cohort, lifecycle, rfm, sales
from tillroll.sources.tpch import load_tpch_tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return load_tpch_tables(spark, sf_dir)


def test_cohorts(t):
    long = cohort.cohort_retention(t, dp=1).collect()
    assert all(r.retention_rate_pct == 100 for r in long if r.month_offset == 0)
    at = {(r.cohort_month, r.month_offset): r.retention_rate_pct for r in long}
    for row in cohort.cohort_retention_pivot(t).collect():
        for k in range(7):
            assert row[f"m{k}_retention_pct"] == at.get((row.cohort_month, k), 0.0)


def test_segments(t):
    rows = rfm.rfm_segment_summary(t).collect()
    customers = t.completed().select("customer_id").distinct().count()
    assert sum(r.total_customers for r in rows) == customers
    assert abs(sum(r.customer_share_pct for r in rows) - 100) < 0.05
    assert abs(sum(r.revenue_share_pct for r in rows) - 100) < 0.05


def test_funnel(t):
    reached = [r.customers_reached_order for r in lifecycle.repurchase_funnel(t).collect()]
    assert reached == sorted(reached, reverse=True)
    assert reached[0] == t.completed().select("customer_id").distinct().count()


def test_last_running_total_is_lifetime_spend(t):
    last = lifecycle.running_spend(t).groupBy("customer_id").agg(
        F.max("running_cumulative_spend").alias("spend")
    )
    both = sales.customer_order_summary(t).join(last, "customer_id")
    assert both.where("spend <> lifetime_spend").count() == 0
    assert both.count() == last.count()
