"""Worked expectations on the hand-made shop, with the order sequence stored and
with the sequence derived from the dates."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fixtures import rows, shop
from tillroll.plans import basket, bi, cohort, export, lifecycle, quality, rfm, sales, stats


@pytest.fixture(scope="module", params=[True, False], ids=["stored", "derived"])
def t(spark, request):
    return shop(spark, stored_sequence=request.param)


def test_kpis(t):
    assert rows(sales.executive_kpis(t)) == [(290.0, 5, 3, 58.0, 108.0, 37.2)]


def test_repeat_rate(t):
    assert rows(lifecycle.repeat_customer_rate(t)) == [(2, 3, 66.7)]


def test_monthly(t):
    got = sales.monthly_sales_summary(t).select(
        "sales_month", "gross_revenue", "gross_margin_pct", "active_customers"
    )
    assert rows(got) == [
        ("2024-01", 180.0, 38.89, 2),
        ("2024-02", 20.0, 40.0, 1),
        ("2024-03", 90.0, 33.33, 2),
    ]


def test_cohorts(t):
    assert rows(cohort.cohort_retention(t)) == [
        ("2024-01", 2, 0, 2, 100.0),
        ("2024-01", 2, 1, 1, 50.0),
        ("2024-01", 2, 2, 1, 50.0),
        ("2024-03", 1, 0, 1, 100.0),
    ]
    assert rows(cohort.cohort_retention_pivot(t)) == [
        ("2024-01", 2, 100.0, 50.0, 50.0, 0.0, 0.0, 0.0, 0.0),
        ("2024-03", 1, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    assert rows(cohort.avg_month1_retention(t)) == [(1, 50.0, 50.0)]


def test_funnel(t):
    assert rows(lifecycle.repurchase_funnel(t)) == [
        (1, 3, 100.0, 0.0),
        (2, 3, 100.0, 0.0),
        (3, 1, 33.33, 66.67),
        (4, 0, 0.0, 100.0),
        (5, 0, 0.0, None),
        (6, 0, 0.0, None),
    ]
    assert rows(lifecycle.conditional_survival(t))[:4] == [
        (1, 3, None),
        (2, 3, 100.0),
        (3, 1, 33.33),
        (4, 0, 0.0),
    ]


def test_funnel_with_late_first_completion(spark):
    orders = [
        (f"O{k}", "C1", f"2024-01-{k:02d}", "Completed" if k == 7 else "Cancelled", k, 10, 4, [1])
        for k in range(1, 9)
    ]
    for stored in (True, False):
        reached = rows(lifecycle.repurchase_funnel(shop(spark, orders, stored)))
        assert [r[1] for r in reached] == [1] * 6


def test_intervals(t):
    assert rows(lifecycle.interpurchase_by_transition(t)) == [
        (2, 1, 65.0, 65.0, 65.0),
        (3, 1, 29.0, 29.0, 29.0),
    ]
    assert rows(lifecycle.repurchase_median(t)) == [(1, 65.0)]


def test_running_spend(t):
    got = {r[0]: r[3:] for r in rows(lifecycle.running_spend(t))}
    day = dt.date.fromisoformat
    assert got == {
        "O1": (1, 100.0, 100.0, None, None),
        "O2": (2, 50.0, 150.0, day("2024-01-10"), 65),
        "O3": (1, 80.0, 80.0, None, None),
        "O5": (3, 20.0, 100.0, day("2024-01-31"), 29),
        "O7": (2, 40.0, 40.0, None, None),
    }
    assert [r[0] for r in rows(lifecycle.running_spend(t, limit=2))] == ["O1", "O2"]


def test_rfm(t):
    got = rfm.rfm_scores(t).select(
        "customer_id", "recency_days", "frequency_orders", "monetary_spend",
        "rfm_cell", "customer_segment",
    )
    assert sorted(rows(got)) == [
        ("C1", 0.0, 2, 150.0, "223", "High-Value Dormant"),
        ("C2", 15.0, 2, 100.0, "132", "At Risk Customers"),
        ("C3", 0.0, 1, 40.0, "311", "Lost / Hibernating"),
    ]
    later = rfm.rfm_scores(t, snapshot=dt.date(2024, 3, 20))
    assert sorted(r[0] for r in later.select("recency_days").collect()) == [5, 5, 20]


def test_basket(t):
    got = rows(basket.market_basket_pairs(t, min_pair_orders=1))
    assert got == [
        (1, "P1", "Odd", 2, "P2", "Even", 2, 3, 3, 40.0, 66.7, 66.7)
    ]
    assert rows(basket.market_basket_pairs(t)) == []
    assert rows(basket.top_pairs_dashboard(t)) == [("P1", "Odd", "P2", "Even", 2, 40.0)]


def test_channels(t):
    assert rows(sales.channel_distribution(t)) == [
        ("Email", 2, 3, 190.0, 63.33),
        ("Referral", 1, 2, 100.0, 50.0),
    ]
    assert rows(stats.h2_channel_contingency(t)) == [
        ("Email", 1, 1, 2, 50.0),
        ("Referral", 1, 1, 2, 50.0),  # C4 never ordered and counts as not repeating
    ]


def test_first_basket(t):
    assert rows(stats.h3_first_basket_ltv(t))[0][:4] == (2, 0, 125.0, None)


def test_categories(t):
    # O4 and O6 do not count; O1 has product 2 twice
    assert rows(sales.category_performance(t)) == [
        ("Odd", 40.0, 24.0, 4, 4),
        ("Even", 40.0, 24.0, 4, 3),
    ] or rows(sales.category_performance(t)) == [
        ("Even", 40.0, 24.0, 4, 3),
        ("Odd", 40.0, 24.0, 4, 4),
    ]


def test_bi(t):
    assert rows(bi.bi_core_measures(t))[0][:2] == (420.0, 153.0)
    assert rows(bi.bi_core_measures(t))[0][3:] == (5, 84.0)
    assert rows(bi.bi_repeat_rate(t)) == [(3, 3, 1.0)]
    growth = rows(bi.bi_yoy_growth(t))
    assert growth == [
        ("2024-01", 180.0, None, 0.0),
        ("2024-02", 150.0, None, 0.0),
        ("2024-03", 90.0, None, 0.0),
    ]
    rolling = {r[0].isoformat(): r[1:] for r in rows(bi.rolling_sales(t))}
    assert len(rolling) == 66
    assert rolling["2024-01-30"] == (0.0, 100.0)
    assert rolling["2024-02-08"] == (0.0, 310.0)  # the 10th of January is day 30
    assert rolling["2024-02-09"] == (0.0, 210.0)
    fields = {r[0]: r[4:] for r in rows(bi.lod_customer_fields(t))}
    assert fields["O5"] == (dt.date(2024, 1, 1), 1, 170.0, 3, 15)
    cohorts = {r[0]: r[3:] for r in rows(bi.bi_cohort_measures(t))}
    assert cohorts["O7"] == (dt.date(2024, 2, 5), dt.date(2024, 2, 1), 1)


def test_yoy_matches_by_month_not_position(spark):
    orders = [
        ("O1", "C1", "2023-01-10", "Completed", 1, 100, 40, [1]),
        ("O2", "C1", "2023-03-10", "Completed", 2, 50, 20, [1]),
        ("O3", "C1", "2024-03-10", "Completed", 3, 75, 20, [1]),
    ]
    assert rows(bi.bi_yoy_growth(shop(spark, orders)))[-1] == ("2024-03", 75.0, 50.0, 0.5)


def test_master(t):
    master = bi.analytics_master(t)
    assert len(master.columns) == 30 and master.count() == 11
    one = master.where("order_id = 'O5'").first()
    assert (one.order_sequence, one.unit_price_x, one.unit_price_y) == (3, 10, 10)


def test_quality(spark, t):
    assert {r[3] for r in rows(quality.dq_keys(t))} == {0}
    broken = shop(spark)
    broken.order_items = broken.order_items.union(broken.order_items.limit(1))
    broken.customers = broken.customers.where("customer_id <> 'C2'")
    bad = {r[:3]: r[3] for r in rows(quality.dq_keys(broken)) if r[3]}
    assert bad == {
        ("primary_key", "order_items", "item_id"): 1,
        ("foreign_key", "orders", "customer_id"): 3,
    }


def test_payload(t):
    document = json.loads(export.dashboard_payload(t).first()[0])
    assert list(document) == [
        "kpis", "repeat_rate", "monthly_trend", "category_performance",
        "cohort_matrix", "rfm_segments", "market_basket", "channels",
    ]
    assert document["kpis"]["total_gmv"] == 290
    assert document["repeat_rate"]["repeat_rate_pct"] == 66.7
    assert [m["month"] for m in document["monthly_trend"]] == ["2024-01", "2024-02", "2024-03"]
    assert [c["acquisition_channel"] for c in document["channels"]] == ["Email", "Referral"]
    assert document["market_basket"][0]["co_orders"] == 2


def test_rolled_up_lines(spark, t):
    headers = spark.createDataFrame(
        [("O1", "0.10", "4.99"), ("O3", "0.05", "0.00")], "order_id string, r string, f string"
    ).selectExpr("order_id", "cast(r as decimal(4,2)) rate", "cast(f as decimal(18,2)) fee")
    got = sales.roll_up_lines(headers, t.order_items, "rate", "fee").select(
        "order_id", "subtotal", "discount_amount", "total_amount", "gross_profit"
    )
    assert sorted(rows(got)) == [
        ("O1", 30.0, 3.0, 31.99, 15.0),
        ("O3", 20.0, 1.0, 19.0, 11.0),
    ]


def test_sequence_follows_the_time_of_day(spark):
    """A at 18:00 and B at 09:00 of one day: B came first, dates alone say A."""
    orders = [
        ("A", "C1", "2024-01-10", "Completed", 0, 100, 40, [1]),
        ("B", "C1", "2024-01-10", "Completed", 0, 50, 20, [1, 2]),
        ("C", "C1", "2024-01-20", "Completed", 0, 10, 5, [1]),
    ]
    t = shop(spark, orders, stored_sequence=False, channels={"C1": "Email"})
    t.orders = t.orders.withColumn(
        "order_date",
        F.when(F.col("order_id") == "A", F.col("order_date") + F.expr("interval 8 hours")).otherwise(
            F.col("order_date")
        ),
    )
    sequence = {r.order_id: r.order_sequence for r in t.sequenced_orders().collect()}
    assert sequence == {"B": 1, "A": 2, "C": 3}
    assert {r.order_id for r in t.first_orders(1).collect()} == {"B"}
    spend = {r.order_id: r for r in lifecycle.running_spend(t).collect()}
    assert {o: r.order_sequence for o, r in spend.items()} == sequence
    assert [float(spend[o].running_cumulative_spend) for o in "ABC"] == [100.0, 150.0, 160.0]
    assert spend["B"].days_since_prior_order == 0
