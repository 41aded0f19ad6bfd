"""Retail tables on top of TPC-H-shaped parquet files.

Line amounts are worked out in integer cents, which are exact and stay inside
generated code; order amounts are the sums over an order's lines, so an order
without lines does not exist. Status, payment method, acquisition channel, unit cost
and shipping are stand-ins built from the nearest columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tillroll.functions.dates import MonthMask
from tillroll.functions.exact import pct
from tillroll.operators.skew import HotKeys, hot_keys, salted_join
from tillroll.sources.schemas import CANCELLED, COMPLETED, RETURNED
from tillroll.sources.tables import RetailTables

# Order state codes; every other code is a cancelled order.
_STATUS_CODES = {COMPLETED: "F", RETURNED: "O"}


def _cents(amount: str) -> str:
    return f"CAST(round({amount} * 100) AS BIGINT)"


def _share(cents: str, percent: str) -> str:
    """``percent`` % of an amount, half-up to the cent."""
    return f"({cents} * {percent} + 50) DIV 100"


def _cost_percent(product_key: str) -> str:
    return f"(40 + {product_key} % 31)"


def _amount(cents: str, digits: int = 15) -> str:
    """Integer cents as DECIMAL(18,2). Up to 15 digits the product stays a decimal that
    Spark holds in a long."""
    return f"CAST(CAST({cents} AS DECIMAL({digits},0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2))"


def _per_unit(cents: str) -> str:
    return f"({cents} * 2 + quantity) DIV (CAST(quantity AS BIGINT) * 2)"


class TpchTables(RetailTables):
    orders_have_lines = True

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._schemas: dict[str, StructType] = {}

    def _raw(self, name: str) -> DataFrame:
        """A stored table; its footers are asked for the schema once per table set."""
        path = f"{self._folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self._spark.read.parquet(path).schema
        return self._spark.read.schema(self._schemas[name]).parquet(path)

    # -- dimensions ------------------------------------------------------------

    @cached_property
    def customer_attributes(self) -> DataFrame:
        # nation and region have a fixed size (25 and 5 rows)
        nation, region = F.broadcast(self._raw("nation")), F.broadcast(self._raw("region"))
        return (
            self._raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("first_name"),
                F.lit(None).cast("string").alias("email"),
                F.col("r_name").alias("region"),
                F.col("c_mktsegment").alias("acquisition_channel"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        first = self._raw("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.to_date(F.min("o_orderdate")).alias("signup_date")
        )
        joined = self.customer_attributes.join(first, "customer_id", "left")
        return joined.select(
            "customer_id",
            "first_name",
            "email",
            "signup_date",
            "region",
            "acquisition_channel",
        )

    @cached_property
    def products(self) -> DataFrame:
        priced = self._raw("part").selectExpr("*", f"{_cents('p_retailprice')} AS price_c")
        costed = priced.selectExpr(
            "*", f"{_share('price_c', _cost_percent('p_partkey'))} AS cost_c"
        )
        margin = pct(F.col("price_c") - F.col("cost_c"), F.col("price_c"), 2)
        return costed.withColumn("margin_percentage", margin).selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS category",
            f"CAST({_amount('price_c')} AS DECIMAL(10,2)) AS unit_price",
            f"CAST({_amount('cost_c')} AS DECIMAL(10,2)) AS unit_cost",
            "margin_percentage",
        )

    # -- facts -----------------------------------------------------------------

    @cached_property
    def _lines(self) -> DataFrame:
        return (
            self._raw("lineitem")
            .selectExpr(
                "l_orderkey AS order_id",
                "l_partkey AS product_id",
                "l_linenumber AS line_number",
                "CAST(l_quantity AS INT) AS quantity",
                f"{_cents('l_extendedprice')} AS price_c",
                f"{_cents('l_discount')} AS discount_pct",
                f"{_cents('l_tax')} AS shipping_pct",
            )
            .selectExpr(
                "*",
                f"{_share('price_c', _cost_percent('product_id'))} AS cost_c",
                f"{_share('price_c', 'discount_pct')} AS discount_c",
                f"{_share('price_c', 'shipping_pct')} AS shipping_c",
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._lines.selectExpr(
            "concat_ws('-', order_id, line_number) AS item_id",
            "order_id",
            "product_id",
            "quantity",
            f"{_amount(_per_unit('price_c'))} AS unit_price",
            f"{_amount(_per_unit('cost_c'))} AS unit_cost",
            f"{_amount('price_c')} AS line_subtotal",
            f"{_amount('cost_c')} AS line_cost",
        )

    def _orders(self, rows: DataFrame) -> DataFrame:
        totals = self._lines.groupBy("order_id").agg(
            F.expr("sum(price_c) AS subtotal_c"),
            F.expr("sum(discount_c) AS discount_c"),
            F.expr("sum(shipping_c) AS shipping_c"),
            F.expr("sum(cost_c) AS cost_c"),
            F.expr("count(*) AS line_count"),
        )
        status = " ".join(f"WHEN '{code}' THEN '{name}'" for name, code in _STATUS_CODES.items())
        # an order's sum has no such bound as a line's amount
        amount = lambda cents: _amount(cents, digits=18)
        return rows.join(totals, rows["o_orderkey"] == totals["order_id"]).selectExpr(
            "order_id",
            "o_custkey AS customer_id",
            "o_orderdate AS order_date",
            "CAST(o_orderdate AS DATE) AS order_date_only",
            f"CASE o_orderstatus {status} ELSE '{CANCELLED}' END AS order_status",
            "o_orderpriority AS payment_method",
            f"{amount('subtotal_c')} AS subtotal",
            f"{amount('discount_c')} AS discount_amount",
            f"{amount('shipping_c')} AS shipping_fee",
            f"{amount('subtotal_c - discount_c + shipping_c')} AS total_amount",
            f"{amount('cost_c')} AS total_cost",
            f"{amount('subtotal_c - discount_c - cost_c')} AS gross_profit",
            "line_count",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders(self._raw("orders"))

    def _rows_with(self, status: str) -> DataFrame:
        """The state is tested on the stored code, so the scan itself filters."""
        rows, code = self._raw("orders"), F.col("o_orderstatus")
        if status in _STATUS_CODES:
            return rows.where(code == _STATUS_CODES[status])
        return rows.where(~code.isin(*_STATUS_CODES.values()))

    def orders_with(self, status: str) -> DataFrame:
        return self._orders(self._rows_with(status))

    def completed_keys(self) -> DataFrame:
        """Without the lines, which whoever joins these keys brings along."""
        return self._rows_with(COMPLETED).select(F.col("o_orderkey").alias("order_id"))

    # -- brands: a coarser product grain --------------------------------------------

    def _part_brands(self) -> DataFrame:
        return self._raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand")
        )

    def brands(self) -> DataFrame:
        return self._part_brands().select("brand").distinct()

    def brand_lines(self) -> DataFrame:
        lines = self._lines.select("order_id", "product_id")
        return salted_join(
            lines, self._part_brands(), "product_id", self.hot_products, ["order_id"]
        ).select("order_id", "brand")

    # -- hot keys from the stored key columns --------------------------------------

    @cached_property
    def hot_customers(self) -> HotKeys:
        return hot_keys(self._raw("orders"), "o_custkey")[0]

    @cached_property
    def month_mask(self) -> MonthMask:
        return self._months_of(self._raw("orders"), "o_orderdate")

    @cached_property
    def _hot_item_keys(self) -> list[HotKeys]:
        return hot_keys(self._raw("lineitem"), "l_orderkey", "l_partkey")


def load_tpch_tables(spark: SparkSession, folder: str) -> TpchTables:
    return TpchTables(spark, folder)
