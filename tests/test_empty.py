"""Shops without orders, or without a completed one, give empty or zero results."""

import pytest

from fixtures import SHOP, rows, shop
from tillroll.plans import basket, bi, cohort, export, lifecycle, quality, rfm, sales, stats

ANALYSES = [
    sales.customer_order_summary,
    sales.monthly_sales_summary,
    sales.executive_kpis,
    sales.category_performance,
    sales.channel_distribution,
    sales.order_rollup,
    cohort.cohort_retention,
    cohort.cohort_retention_pivot,
    cohort.avg_month1_retention,
    rfm.rfm_scores,
    rfm.rfm_segment_summary,
    rfm.threshold_segments,
    lifecycle.running_spend,
    lifecycle.repurchase_funnel,
    lifecycle.interpurchase_by_transition,
    lifecycle.repurchase_median,
    lifecycle.repeat_customer_rate,
    basket.market_basket_pairs,
    basket.top_pairs_dashboard,
    stats.test_results_table,
    bi.analytics_master,
    bi.bi_core_measures,
    bi.bi_yoy_growth,
    bi.rolling_sales,
    bi.lod_customer_fields,
    quality.dq_keys,
    export.dashboard_payload,
]


@pytest.mark.parametrize("analysis", ANALYSES, ids=lambda f: f.__name__)
def test_no_orders(spark, analysis):
    rows(analysis(shop(spark, [])))


@pytest.mark.parametrize("analysis", ANALYSES, ids=lambda f: f.__name__)
def test_nothing_completed(spark, analysis):
    returned = [o[:3] + ("Returned",) + o[4:] for o in SHOP]
    rows(analysis(shop(spark, returned, stored_sequence=False)))


def test_values(spark):
    t = shop(spark, [])
    assert rows(sales.executive_kpis(t)) == [(None, 0, 0, None, None, None)]
    assert [r[1] for r in rows(lifecycle.repurchase_funnel(t))] == [0] * 6
    assert rows(bi.bi_core_measures(t)) == [(None, None, 0.0, 0, 0.0)]
    assert {r.verdict[:3] for r in stats.test_results_table(t).collect()} == {"Not"}
