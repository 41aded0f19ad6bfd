"""Repurchase behaviour of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillroll.functions.exact import mean, pct
from tillroll.operators.scan import ordered_scan
from tillroll.sources.schemas import COMPLETED
from tillroll.sources.tables import ORDER_OF_PURCHASE, RetailTables


def _is_completed():
    return F.col("order_status") == COMPLETED


def running_spend(t: RetailTables, limit: int | None = None) -> DataFrame:
    """Completed orders with cumulative spend and the gap to the previous one.

    The ordinal counts orders of every status by the moment of purchase; the running sum
    and the previous date count completed orders by date. Both share one shuffle.
    """
    rows = t.orders.select(
        "order_id",
        "customer_id",
        "order_date",
        "order_date_only",
        "order_status",
        "total_amount",
        *(["order_sequence"] if t.has_sequence else []),
    )
    scanned = ordered_scan(
        t.sequenced_orders(rows),
        "customer_id",
        ORDER_OF_PURCHASE,
        t.hot_customers,
        sums={
            "running_cumulative_spend": F.when(_is_completed(), F.col("total_amount"))
        },
        prev_max={
            # dates ascend, so the latest completed date so far is the previous one
            "prev_order_date": F.when(_is_completed(), F.col("order_date_only"))
        },
    )
    out = scanned.where(_is_completed()).select(
        "order_id",
        "customer_id",
        "order_date_only",
        "order_sequence",
        "total_amount",
        "running_cumulative_spend",
        "prev_order_date",
        F.datediff("order_date_only", "prev_order_date").alias("days_since_prior_order"),
    )
    if limit is not None:
        out = out.orderBy("customer_id", *ORDER_OF_PURCHASE).limit(limit)
    return out


def _reached(t: RetailTables, max_milestone: int) -> DataFrame:
    """``k, reached`` for the milestones some customer reached.

    A customer has reached milestone k with a completed order of ordinal >= k.
    """
    if t.has_sequence:
        furthest = (
            t.completed()
            .groupBy("customer_id")
            .agg(F.max("order_sequence").alias("furthest"))
        )
        upto = F.least(F.col("furthest"), F.lit(max_milestone))
        return (
            furthest.groupBy(upto.alias("upto"))
            .agg(F.count("*").alias("customers"))
            .select(F.explode(F.sequence(F.lit(1), "upto")).alias("k"), "customers")
            .groupBy("k")
            .agg(F.sum("customers").alias("reached"))
        )
    # Some completed order has ordinal >= k unless all of them are among the first
    # k - 1. Both sides are small per customer before they are shuffled: at most
    # max_milestone rows, and one count.
    in_total = t.completed().groupBy("customer_id").agg(F.count("*").alias("in_total"))
    earlier = (
        W.partitionBy("customer_id")
        .orderBy("order_sequence")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        t.first_orders(max_milestone)
        .select(
            "customer_id",
            F.col("order_sequence").alias("k"),
            F.count(F.when(_is_completed(), 1)).over(earlier).alias("before"),
        )
        .join(in_total, "customer_id")
        .where(F.col("before") < F.col("in_total"))
        .groupBy("k")
        .agg(F.count("*").alias("reached"))
    )


def repurchase_funnel(t: RetailTables, max_milestone: int = 6) -> DataFrame:
    milestones = t.completed().sparkSession.range(1, max_milestone + 1, 1, 1).select(
        F.col("id").cast("int").alias("k")
    )
    ordered = W.orderBy("k")  # max_milestone rows
    reached = F.col("reached")
    previous = F.coalesce(F.lag("reached").over(ordered), reached)
    return (
        milestones.join(_reached(t, max_milestone), "k", "left")
        .select("k", F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached"))
        .withColumn("previous", previous)
        .withColumn("most", F.max("reached").over(W.partitionBy()))
        .select(
            F.col("k").alias("order_sequence_milestone"),
            reached.alias("customers_reached_order"),
            pct(reached, F.col("most"), 2).alias("survival_rate_pct"),
            pct(F.col("previous") - reached, F.col("previous"), 2).alias(
                "marginal_churn_rate_pct"
            ),
        )
        .orderBy("order_sequence_milestone")
    )


def conditional_survival(t: RetailTables, max_milestone: int = 6) -> DataFrame:
    """Share of those at milestone k - 1 who reach milestone k."""
    reached = F.col("customers_reached_order")
    ordered = W.orderBy("order_sequence_milestone")
    return (
        repurchase_funnel(t, max_milestone)
        .withColumn("previous", F.lag("customers_reached_order").over(ordered))
        .select(
            "order_sequence_milestone",
            "customers_reached_order",
            pct(reached, F.col("previous"), 2).alias("conditional_survival_pct"),
        )
        .orderBy("order_sequence_milestone")
    )


def _intervals(t: RetailTables, max_sequence: int) -> DataFrame:
    """``order_sequence, days`` since the previous completed order.

    The gap is between completed orders, the label is the ordinal over all orders.
    """
    if t.has_sequence:
        rows = ordered_scan(
            t.completed().select("customer_id", "order_sequence", *ORDER_OF_PURCHASE),
            "customer_id",
            ORDER_OF_PURCHASE,
            t.hot_customers,
            prev_max={"previous": F.col("order_date_only")},
        ).where(F.col("order_sequence") <= max_sequence)
    else:
        # Of a customer's first few orders only those are ever shuffled, and the orders
        # of earlier days are among them. The order before by date and id can also be a
        # later one of the same day, with a smaller id: the least id of a day tells.
        days_before = (
            W.partitionBy("customer_id")
            .orderBy(F.unix_date("order_date_only"))
            .rangeBetween(W.unboundedPreceding, -1)
        )
        least = (
            t.completed()
            .groupBy("customer_id", "order_date_only")
            .agg(F.min("order_id").alias("least"))
        )
        rows = (
            t.first_orders(max_sequence)
            .where(_is_completed())
            .withColumn("earlier", F.max("order_date_only").over(days_before))
            .join(least, ["customer_id", "order_date_only"])
            .withColumn(
                "previous",
                F.when(F.col("least") < F.col("order_id"), F.col("order_date_only")).otherwise(
                    F.col("earlier")
                ),
            )
        )
    return rows.where(F.col("previous").isNotNull()).select(
        "order_sequence", F.datediff("order_date_only", "previous").alias("days")
    )


def interpurchase_by_transition(t: RetailTables, max_sequence: int = 5) -> DataFrame:
    return (
        _intervals(t, max_sequence)
        .groupBy(F.col("order_sequence").alias("order_transition_to"))
        .agg(
            F.count("*").alias("total_transitions"),
            mean(F.sum("days"), F.count("*"), 1).alias("avg_days_to_repurchase"),
            F.min("days").cast("double").alias("min_days"),
            F.max("days").cast("double").alias("max_days"),
        )
        .orderBy("order_transition_to")
    )


def repurchase_median(t: RetailTables, transition_to: int = 2) -> DataFrame:
    """Exact median gap; its state is a count per whole day, not the rows."""
    return (
        _intervals(t, transition_to)
        .where(F.col("order_sequence") == transition_to)
        .agg(
            F.count("*").alias("transitions"),
            F.median("days").alias("median_days"),
        )
    )


def repeat_customer_rate(t: RetailTables) -> DataFrame:
    repeat = F.count_if(F.col("total_orders") > 1)
    return t.customer_totals().agg(
        repeat.alias("repeat_customers"),
        F.count("*").alias("total_customers"),
        pct(repeat, F.count("*"), 1).alias("repeat_rate_pct"),
    )
