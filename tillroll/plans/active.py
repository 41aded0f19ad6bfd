"""Distinct customers at every level of a slice, from one set of mergeable bitmaps.

A distinct count cannot be added up: a customer of two months is one customer of the
year. Its set can: customers are bits of bitmaps (32,768 to a bitmap), built once at the
finest slice and merged by OR for coarser ones, exact at every level and without a
second pass over the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from tillroll.functions.dates import month_number
from tillroll.operators.positions import positions
from tillroll.operators.scratch import materialize
from tillroll.operators.skew import salted_join
from tillroll.sources.tables import RetailTables


def _numbered(t: RetailTables, orders: DataFrame) -> DataFrame:
    """``orders`` with ``number``, a customer's bit: the id if that is a number, else its
    place among all ids."""
    if isinstance(orders.schema["customer_id"].dataType, IntegralType):
        return orders.withColumn("number", F.col("customer_id").cast("bigint"))
    ids = orders.select("customer_id").where("customer_id is not null").distinct()
    places = positions(ids, [], [F.col("customer_id")], "customers").select("customer_id", F.col("pos").alias("number"))
    return salted_join(orders, places, "customer_id", t.hot_customers, ["order_id"], how="left")


def customer_bitmaps(t: RetailTables) -> DataFrame:
    """Stored, one row per (region, month, bucket of customers): ``bits`` and ``orders``."""
    orders = _numbered(t, t.completed().select("order_id", "customer_id", "order_date_only"))
    per_customer = orders.groupBy(
        "customer_id", "number", month_number(F.col("order_date_only")).alias("month_no")
    ).agg(F.count("*").alias("orders"))
    regions = t.customer_attributes.select("customer_id", "region")
    sliced = per_customer.join(regions, "customer_id")
    return materialize(
        sliced.groupBy("region", "month_no", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"),
            F.sum("orders").alias("orders"),
        ),
        "customer-bitmaps",
    )


#: Levels from the finest to the total.
LEVELS = {
    "region month": ["region", "sales_year", "sales_month"],
    "region year": ["region", "sales_year"],
    "region": ["region"],
    "month": ["sales_year", "sales_month"],
    "year": ["sales_year"],
    "total": [],
}


def active_customers_rollup(t: RetailTables) -> DataFrame:
    """Customers with a completed order, and their orders, at every level."""
    stored = customer_bitmaps(t).select(
        "region",
        F.floor(F.col("month_no") / 12).cast("int").alias("sales_year"),
        (F.col("month_no") % 12 + 1).cast("int").alias("sales_month"),
        "bucket",
        "bits",
        "orders",
    )
    slices = ["region", "sales_year", "sales_month"]
    # The bitmaps meet per bucket; a bucket counts at most 32,768 customers of a slice.
    merged = stored.groupingSets([[*cut, "bucket"] for cut in LEVELS.values()], *slices, "bucket").agg(
        F.grouping_id().alias("level_no"),
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("customers"),
        F.sum("orders").alias("orders"),
    )
    return (
        merged.groupBy("level_no", *slices)
        .agg(F.sum("customers").alias("active_customers"), F.sum("orders").alias("orders"))
        .select(_level_name().alias("level"), *slices, "active_customers", "orders")
        .orderBy("level", *slices)
    )


def _level_name():
    """From the grouping id: bits of region, year, month and bucket, 1 where rolled up."""
    name = F.lit(None).cast("string")
    for label, cut in LEVELS.items():
        bits = 0
        for c in ["region", "sales_year", "sales_month"]:
            bits = bits * 2 + (c not in cut)
        name = F.when(F.col("level_no") == bits * 2, label).otherwise(name)
    return name
