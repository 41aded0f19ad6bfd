"""Measures of the BI model. Unlike the reports, they do not filter by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from tillroll.functions.dates import month_label, month_number
from tillroll.functions.exact import safe_divide
from tillroll.operators.scratch import materialize
from tillroll.operators.skew import salted_join, with_group_values
from tillroll.sources.calendar import calendar
from tillroll.sources.schemas import COMPLETED
from tillroll.sources.tables import RetailTables


def analytics_master(t: RetailTables) -> DataFrame:
    """One wide row per line, inner-joined. Prices occur on lines (``_x``) and on
    products (``_y``)."""
    items = t.order_items.withColumnsRenamed(
        {"unit_price": "unit_price_x", "unit_cost": "unit_cost_x"}
    )
    products = t.products.withColumnsRenamed(
        {"unit_price": "unit_price_y", "unit_cost": "unit_cost_y"}
    )
    # The sequence leaves orders partitioned by customer, so customers join there,
    # at order grain. Lines meet their product while they are still narrow and then
    # their order: each side is moved once per join, the wide rows never.
    orders = salted_join(
        t.sequenced_orders().drop("line_count"),
        t.customers,
        "customer_id",
        t.hot_customers,
        ["order_id"],
    )
    sold = salted_join(items, products, "product_id", t.hot_products, ["item_id"])
    wide = salted_join(sold, orders, "order_id", t.hot_orders, ["item_id", "product_id"])
    return wide.select(
        "item_id",
        "order_id",
        "product_id",
        "quantity",
        "unit_price_x",
        "unit_cost_x",
        "line_subtotal",
        "line_cost",
        "customer_id",
        "order_date",
        "order_date_only",
        "order_status",
        "payment_method",
        "subtotal",
        "discount_amount",
        "shipping_fee",
        "total_amount",
        "total_cost",
        "gross_profit",
        "order_sequence",
        "first_name",
        "email",
        "signup_date",
        "region",
        "acquisition_channel",
        "product_name",
        "category",
        "unit_price_y",
        "unit_cost_y",
        "margin_percentage",
    )


def _sliced_orders(
    t: RetailTables, by: list[str], sums: dict[str, Column], *keys: Column
) -> DataFrame:
    """``sums`` of the orders per ``by`` and ``keys``, whether ``by`` names columns of the
    order or of its customer.

    Slices by customer columns sum up each customer's orders before they meet the
    customer, so one row per customer and order slice is joined.
    """
    of_order = [c for c in by if c in t.orders.columns]
    of_customer = [c for c in by if c not in of_order]
    named = [F.col(c) for c in of_order] + list(keys)
    first = named + ([F.col("customer_id")] if of_customer else [])
    rows = t.orders.groupBy(*first).agg(*[v.alias(n) for n, v in sums.items()])
    if not of_customer:
        return rows
    rows = rows.join(t.customer_attributes.select("customer_id", *of_customer), "customer_id")
    every = [c for c in rows.columns if c not in (*sums, "customer_id")]
    return rows.groupBy(*every).agg(*[F.sum(n).alias(n) for n in sums])


def bi_core_measures(t: RetailTables, by: list[str] | None = None) -> DataFrame:
    """The measures over all orders, or per slice of order or customer columns."""
    by = by or []
    totals = _sliced_orders(
        t,
        by,
        {
            "total_sales": F.sum("total_amount"),
            "total_gross_profit": F.sum("gross_profit"),
            "total_completed_orders": F.count_if(F.col("order_status") == COMPLETED),
        },
    )
    sales = F.col("total_sales")
    return totals.select(
        *by,
        "total_sales",
        "total_gross_profit",
        safe_divide(F.col("total_gross_profit"), sales).alias("gross_margin"),
        "total_completed_orders",
        safe_divide(sales, F.col("total_completed_orders")).alias("average_order_value"),
    )


def bi_prior_year_daily(t: RetailTables) -> DataFrame:
    """Sales per day and those of the same day a year earlier (29 February: the 28th)."""
    daily = materialize(
        t.orders.groupBy(F.col("order_date_only").alias("date")).agg(
            F.sum("total_amount").alias("total_sales")
        ),
        "daily",
    )
    prior = daily.select(F.col("date").alias("day_prior"), F.col("total_sales").alias("sales_prior_year"))
    return (
        daily.withColumn("day_prior", F.add_months("date", -12))
        .join(prior, "day_prior", "left")
        .select("date", "total_sales", "sales_prior_year")
        .orderBy("date")
    )


def bi_yoy_growth(t: RetailTables, by: list[str] | None = None) -> DataFrame:
    """Sales per month, the same month a year earlier, and the growth; over all orders, or
    per slice of order or customer columns.

    The earlier month is found by its number, so a gap in the months is no matter.
    """
    by = by or []
    month = month_number(F.col("order_date_only")).alias("month_no")
    monthly = _sliced_orders(t, by, {"total_sales": F.sum("total_amount")}, month)
    # one row per month and slice
    year_ago = W.partitionBy(*by).orderBy("month_no").rangeBetween(-12, -12)
    sales, prior = F.col("total_sales"), F.col("sales_prior_year")
    return (
        monthly.withColumn("sales_prior_year", F.sum("total_sales").over(year_ago))
        .select(
            *by,
            month_label(F.col("month_no")).alias("month"),
            "total_sales",
            "sales_prior_year",
            safe_divide(sales - prior, prior).alias("yoy_sales_growth"),
        )
        .orderBy(*by, "month")
    )


def rolling_sales(t: RetailTables, days: int = 30, by: list[str] | None = None) -> DataFrame:
    """Sales of the ``days`` days up to each day of the calendar, sold on or not; over all
    orders, or per slice of order or customer columns."""
    by = by or []
    # one row per day and slice, written so that the calendar does not read the facts again
    date = F.col("order_date_only").alias("date")
    daily = materialize(_sliced_orders(t, by, {"sales": F.sum("total_amount")}, date), "daily")
    # days of a slice only
    trailing = W.partitionBy(*by).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    if by:
        span = daily.agg(F.min("date"), F.max("date")).first()
        first, last = (F.lit(d).cast("date") for d in span)
        dates = daily.select(*by).distinct().withColumn("date", F.explode(F.sequence(first, last)))
    else:
        dates = calendar(daily, "date")
    return (
        dates.join(daily, [*by, "date"], "left")
        .select(
            *by,
            "date",
            F.coalesce("sales", F.lit(0)).alias("total_sales"),
            F.coalesce(F.sum("sales").over(trailing), F.lit(0)).alias("rolling_sales"),
        )
        .orderBy(*by, "date")
    )


def _with_customer_values(t: RetailTables, **values: Column) -> DataFrame:
    """Orders of every status with aggregates of their customer attached."""
    orders = t.orders.select("order_id", "customer_id", "order_date_only", "total_amount")
    return with_group_values(orders, "customer_id", t.hot_customers, values)


def bi_cohort_measures(t: RetailTables) -> DataFrame:
    first = F.col("first_order_date")
    return _with_customer_values(
        t, first_order_date=F.min("order_date_only")
    ).select(
        "order_id",
        "customer_id",
        "order_date_only",
        "first_order_date",
        F.trunc(first, "month").alias("cohort_month"),
        (month_number(F.col("order_date_only")) - month_number(first)).alias(
            "cohort_index"
        ),
    )


def bi_repeat_rate(t: RetailTables, by: list[str] | None = None) -> DataFrame:
    """Customers with more than one order, over all orders or within each slice of order
    or customer columns."""
    by = by or []
    of_order = [c for c in by if c in t.orders.columns]
    of_customer = [c for c in by if c not in of_order]
    counts = t.orders.groupBy("customer_id", *of_order).agg(F.count("*").alias("n"))
    if of_customer:
        counts = counts.join(t.customer_attributes.select("customer_id", *of_customer), "customer_id")
    repeat = F.count_if(F.col("n") > 1)
    return counts.groupBy(*by).agg(
        repeat.alias("repeat_customers"),
        F.count("*").alias("total_customers"),
        safe_divide(repeat, F.count("*")).alias("repeat_customer_rate"),
    )


def lod_customer_fields(t: RetailTables) -> DataFrame:
    """Customer-level fields on each order, recency up to the latest order of all.

    The latest date is known only when all orders have been seen. It is accumulated while
    the fields are written, so the orders are derived once.
    """
    month = F.trunc("order_date_only", "month")
    fields = _with_customer_values(
        t,
        cohort_month=F.min(month),
        customer_ltv=F.sum("total_amount"),
        order_frequency=F.count("*"),
        last_order_date=F.max("order_date_only"),
    )
    seen = Observation("lod")
    stored = materialize(fields.observe(seen, F.max("last_order_date").alias("latest")), "lod")
    latest = F.lit(seen.get["latest"]).cast("date")
    return stored.select(
        "order_id",
        "customer_id",
        "order_date_only",
        "total_amount",
        "cohort_month",
        (
            month_number(F.col("order_date_only")) - month_number(F.col("cohort_month"))
        ).alias("cohort_index"),
        "customer_ltv",
        "order_frequency",
        F.datediff(latest, "last_order_date").alias("recency_days"),
    )
