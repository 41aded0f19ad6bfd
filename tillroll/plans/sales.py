"""Sales, margin and customer rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.dates import month_label
from tillroll.functions.exact import mean, pct
from tillroll.operators.skew import salted_join
from tillroll.sources.tables import RetailTables


def customer_order_summary(t: RetailTables) -> DataFrame:
    return (
        t.customers.join(t.customer_totals(), "customer_id")
        .select(
            "customer_id",
            "region",
            "acquisition_channel",
            "signup_date",
            "first_order_date",
            "last_order_date",
            "total_orders",
            "lifetime_spend",
            mean(F.col("lifetime_spend"), F.col("total_orders")).alias("avg_order_value"),
            "lifetime_gross_profit",
        )
    )


def monthly_sales_summary(t: RetailTables) -> DataFrame:
    revenue, profit = F.col("gross_revenue"), F.col("total_gross_profit")
    return (
        t.month_totals().select(
            month_label(F.col("month_no")).alias("sales_month"),
            "total_orders",
            "active_customers",
            "gross_revenue",
            "total_discounts",
            "total_gross_profit",
            pct(profit, revenue, 2).alias("gross_margin_pct"),
            mean(revenue, F.col("total_orders")).alias("avg_order_value"),
        )
        .orderBy("sales_month")
    )


def monthly_trend(t: RetailTables) -> DataFrame:
    """The dashboard's subset of the monthly summary."""
    return monthly_sales_summary(t).select(
        F.col("sales_month").alias("month"),
        F.col("gross_revenue").alias("revenue"),
        F.col("total_gross_profit").alias("profit"),
        F.col("total_orders").alias("orders"),
        "active_customers",
        F.col("avg_order_value").alias("aov"),
    )


def create_report_views(t: RetailTables) -> None:
    """The two standing reports under their SQL names."""
    customer_order_summary(t).createOrReplaceTempView("vw_customer_order_summary")
    monthly_sales_summary(t).createOrReplaceTempView("vw_monthly_sales_summary")


def executive_kpis(t: RetailTables) -> DataFrame:
    gmv, profit, orders = (F.col(c) for c in ("gross_revenue", "total_gross_profit", "total_orders"))
    return t.totals().select(
        gmv.alias("total_gmv"),
        orders,
        F.col("active_customers").alias("total_customers"),
        mean(gmv, orders).alias("avg_order_value"),
        profit,
        pct(profit, gmv, 1).alias("gross_margin_pct"),
    )


def category_performance(t: RetailTables) -> DataFrame:
    """Line-level sales per category, before the order discount."""
    return (
        salted_join(
            t.sold_products(),
            t.products.select("product_id", "category"),
            "product_id",
            t.hot_products,
            ["order_id"],
        )
        .groupBy("category")
        .agg(
            F.sum("sales").alias("total_sales"),
            F.sum("profit").alias("category_profit"),
            F.sum("units").alias("units_sold"),
            F.countDistinct("order_id").alias("order_appearances"),
        )
        .orderBy(F.desc("total_sales"), "category")
    )


def channel_distribution(t: RetailTables) -> DataFrame:
    """Orders are counted per customer before customers meet their channel."""
    revenue, orders = F.col("revenue"), F.col("orders")
    return (
        t.customer_totals()
        .join(
            t.customer_attributes.select("customer_id", "acquisition_channel"),
            "customer_id",
        )
        .groupBy("acquisition_channel")
        .agg(
            F.count("*").alias("customers"),
            F.sum("total_orders").alias("orders"),
            F.sum("lifetime_spend").alias("revenue"),
        )
        .withColumn("aov", mean(revenue, orders))
        .orderBy(F.desc("revenue"), "acquisition_channel")
    )


def order_rollup(t: RetailTables) -> DataFrame:
    """Orders of every status with their line totals and purchase ordinal."""
    return t.sequenced_orders().select(
        "order_id",
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
    )


def roll_up_lines(
    headers: DataFrame, items: DataFrame, discount_rate: str, shipping_fee: str
) -> DataFrame:
    """Order amounts from lines for orders that carry a discount rate (of up to four
    decimals) and a fee; the discount is rounded half-up to the cent."""
    lines = items.groupBy("order_id").agg(
        F.sum("line_subtotal").alias("subtotal"),
        F.sum("line_cost").alias("total_cost"),
    )
    subtotal, discount = F.col("subtotal"), F.col("discount_amount")
    return (
        headers.join(lines, "order_id")
        .withColumn(
            "discount_amount",
            F.round(
                subtotal.cast("decimal(18,2)") * F.col(discount_rate).cast("decimal(9,4)"), 2
            ).cast("decimal(18,2)"),
        )
        .withColumn("total_amount", subtotal - discount + F.col(shipping_fee))
        .withColumn("gross_profit", subtotal - discount - F.col("total_cost"))
    )


def product_margin(t: RetailTables) -> DataFrame:
    price, cost = F.col("unit_price"), F.col("unit_cost")
    return t.products.withColumn("margin_percentage", pct(price - cost, price, 2))


def category_count(t: RetailTables) -> DataFrame:
    return t.products.agg(
        F.count("*").alias("products"),
        F.countDistinct("category").alias("categories"),
    )
