"""Recency, frequency and monetary segmentation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.functions.exact import mean, pct
from tillroll.operators.scratch import materialize
from tillroll.operators.tiles import add_ntiles
from tillroll.sources.tables import RetailTables

R, FQ, M = "r_score", "f_score", "m_score"


# Segment rules, first match wins. Each condition is
# (score, comparison, bound).
SEGMENT_RULES = [
    ("Champions", [(R, ">=", 4), (FQ, ">=", 4), (M, ">=", 4)]),
    ("Loyal Customers", [(R, ">=", 3), (FQ, ">=", 3)]),
    ("Promising New Customers", [(R, ">=", 4), (FQ, "<=", 2)]),
    ("Potential Loyalists", [(R, ">=", 3), (FQ, "<=", 3), (M, ">=", 3)]),
    ("At Risk Customers", [(R, "<=", 2), (FQ, ">=", 3)]),
    ("High-Value Dormant", [(R, "<=", 2), (FQ, "<=", 2), (M, ">=", 3)]),
]
OTHERWISE = "Lost / Hibernating"

DASHBOARD_RULES = [
    ("Promising New" if name == "Promising New Customers" else name, rule)
    for name, rule in SEGMENT_RULES
]
FIVE_SEGMENT_RULES = [
    (name, rule)
    for name, rule in DASHBOARD_RULES
    if name not in ("Potential Loyalists", "High-Value Dormant")
]


def segment(rules: list = SEGMENT_RULES) -> Column:
    """CASE ladder over the three scores."""

    def holds(conditions):
        out = F.lit(True)
        for column, op, bound in conditions:
            c = F.col(column)
            out = out & (c >= bound if op == ">=" else c <= bound)
        return out

    (first, rule), *rest = rules
    ladder = F.when(holds(rule), first)
    for name, rule in rest:
        ladder = ladder.when(holds(rule), name)
    return ladder.otherwise(OTHERWISE)


def rfm_scores(
    t: RetailTables,
    rules: list = SEGMENT_RULES,
    tiles: int = 5,
    snapshot: dt.date | None = None,
) -> DataFrame:
    """One row per customer with a completed order.

    ``snapshot`` is the day recency is counted to, by default the last completed
    order. Ties in a score are broken by customer id.
    """
    raw = t.customer_totals().select(
        "customer_id",
        "last_order_date",
        F.col("total_orders").alias("frequency_orders"),
        F.col("lifetime_spend").alias("monetary_spend"),
        F.col("lifetime_gross_profit").alias("total_profit"),
    )
    raw = raw.join(t.customer_attributes.drop("email"), "customer_id")
    # Customer grain, read several times below; facts are scanned once.
    raw = materialize(raw, "rfm")
    size = raw.agg(F.count("*").alias("n"), F.max("last_order_date").alias("last")).first()
    recency = F.datediff(F.lit(snapshot or size["last"]).cast("date"), "last_order_date")
    scored = add_ntiles(
        raw.withColumn("recency_days", recency),
        size["n"],
        "customer_id",
        {
            R: -F.col("recency_days"),
            FQ: F.col("frequency_orders"),
            M: F.col("monetary_spend"),
        },
        tiles,
    )
    return scored.select(
        "customer_id",
        "first_name",
        "region",
        "acquisition_channel",
        F.col("recency_days").cast("double").alias("recency_days"),
        "frequency_orders",
        "monetary_spend",
        "total_profit",
        R,
        FQ,
        M,
        F.concat(*[F.col(c).cast("string") for c in (R, FQ, M)]).alias("rfm_cell"),
        segment(rules).alias("customer_segment"),
    )


def _by_segment(scores: DataFrame) -> DataFrame:
    return scores.groupBy("customer_segment").agg(
        F.count("*").alias("customers"),
        F.sum("monetary_spend").alias("revenue"),
        F.sum("frequency_orders").alias("orders"),
        F.sum(F.col("recency_days").cast("bigint")).alias("days"),
    )


def rfm_segment_summary(t: RetailTables, **params) -> DataFrame:
    everyone = W.partitionBy()  # over the handful of segment rows
    n, revenue = F.col("customers"), F.col("revenue")
    return (
        _by_segment(rfm_scores(t, **params))
        .withColumn("all_customers", F.sum("customers").over(everyone))
        .withColumn("all_revenue", F.sum("revenue").over(everyone))
        .select(
            "customer_segment",
            n.alias("total_customers"),
            pct(n, F.col("all_customers"), 2).alias("customer_share_pct"),
            revenue.alias("segment_revenue"),
            pct(revenue, F.col("all_revenue"), 2).alias("revenue_share_pct"),
            mean(revenue, n, 2).alias("avg_customer_spend"),
            mean(F.col("orders"), n, 1).alias("avg_order_frequency"),
            mean(F.col("days"), n, 1).alias("avg_recency_days"),
        )
        .orderBy(F.desc("segment_revenue"), "customer_segment")
    )


def rfm_dashboard(t: RetailTables, **params) -> DataFrame:
    n, revenue = F.col("customers"), F.col("revenue")
    return (
        _by_segment(rfm_scores(t, rules=DASHBOARD_RULES, **params))
        .select(
            F.col("customer_segment").alias("segment"),
            n.alias("customer_count"),
            revenue.alias("total_revenue"),
            mean(revenue, n, 2).alias("avg_spend"),
            mean(F.col("orders"), n, 1).alias("avg_orders"),
            mean(F.col("days"), n, 0).alias("avg_recency_days"),
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def rfm_five_segments(t: RetailTables, **params) -> DataFrame:
    n, revenue = F.col("customers"), F.col("revenue")
    return (
        _by_segment(rfm_scores(t, rules=FIVE_SEGMENT_RULES, **params))
        .select(
            F.col("customer_segment").alias("segment"),
            n.alias("total_customers"),
            revenue.alias("total_revenue"),
            mean(revenue, n, 2).alias("avg_spend"),
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


# The default bounds are those of the BI model.
@dataclass(frozen=True)
class Thresholds:
    champion_days: int = 90
    champion_orders: int = 4
    champion_spend: int = 500
    loyal_days: int = 180
    loyal_orders: int = 3
    new_days: int = 60
    new_orders: int = 2


def threshold_segments(
    t: RetailTables,
    bounds: Thresholds = Thresholds(),
    snapshot: dt.date | None = None,
) -> DataFrame:
    """Segments by fixed thresholds over orders of every status, per customer.

    Recency counts to ``snapshot``, by default the latest order of all.
    """
    # written at customer grain, so the facts are read once for both uses
    per_customer = materialize(
        t.orders.groupBy("customer_id").agg(
            F.max("order_date_only").alias("last_order_date"),
            F.count("*").alias("order_frequency"),
            F.sum("total_amount").alias("customer_ltv"),
        ),
        "customers",
    )
    if snapshot is None:
        snapshot = per_customer.agg(F.max("last_order_date")).first()[0]
    days, orders, spend = (
        F.col(c) for c in ("recency_days", "order_frequency", "customer_ltv")
    )
    champion = (
        (days <= bounds.champion_days)
        & (orders >= bounds.champion_orders)
        & (spend >= bounds.champion_spend)
    )
    regular = orders >= bounds.loyal_orders
    recently_new = (days <= bounds.new_days) & (orders <= bounds.new_orders)
    return per_customer.select(
        "customer_id",
        F.datediff(F.lit(snapshot).cast("date"), "last_order_date").alias("recency_days"),
        "order_frequency",
        "customer_ltv",
    ).withColumn(
        "rfm_segment",
        F.when(champion, "Champions")
        .when((days <= bounds.loyal_days) & regular, "Loyal Customers")
        .when(recently_new, "Promising New")
        .when((days > bounds.loyal_days) & regular, "At Risk Customers")
        .otherwise(OTHERWISE),
    )
