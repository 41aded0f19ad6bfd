"""The four retail tables and the derived forms several analyses share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.functions.dates import MonthMask, month_number
from tillroll.operators.scan import ordered_scan
from tillroll.operators.skew import HotKeys, hot_keys, salted_join
from tillroll.sources.schemas import COMPLETED

# The purchase ordinal follows the time of day; running values go by date, then id.
ORDER_OF_PURCHASE = ["order_date_only", "order_id"]
ORDER_OF_SEQUENCE = ["order_date", "order_id"]


class RetailTables:
    """Customers, products, orders and order items as lazy DataFrames.

    Where ``orders`` has an ``order_sequence`` column it is taken as given. Otherwise
    the sequence is each customer's purchases of *any* status in order of the moment of
    purchase, then order id.
    """

    #: Whether an order is the sum of its lines, so that there is none without lines.
    orders_have_lines = False

    def __init__(
        self,
        customers: DataFrame,
        products: DataFrame,
        orders: DataFrame,
        order_items: DataFrame,
    ):
        self.customers = customers
        self.products = products
        self.orders = orders
        self.order_items = order_items

    # -- populations -----------------------------------------------------------

    def orders_with(self, status: str) -> DataFrame:
        return self.orders.where(F.col("order_status") == status)

    def completed(self) -> DataFrame:
        return self.orders_with(COMPLETED)

    def completed_keys(self) -> DataFrame:
        """``order_id`` of completed orders, to restrict lines with."""
        return self.completed().select("order_id")

    @property
    def customer_attributes(self) -> DataFrame:
        """Customers without the signup date."""
        return self.customers.drop("signup_date")

    @property
    def order_line_count(self) -> list[str]:
        """The column of ``orders`` with its number of lines, if there is one."""
        return [c for c in self.orders.columns if c == "line_count"]

    def line_counts(self) -> DataFrame:
        """Lines per order, counted before any join so a huge order is one row."""
        return self.order_items.groupBy("order_id").agg(
            F.count("item_id").alias("line_count")
        )

    # -- hot keys: hints for spreading work, one narrow scan each -----------------

    @cached_property
    def hot_customers(self) -> HotKeys:
        return hot_keys(self.orders, "customer_id")[0]

    @cached_property
    def _hot_item_keys(self) -> list[HotKeys]:
        return hot_keys(self.order_items, "order_id", "product_id")

    @property
    def hot_orders(self) -> HotKeys:
        return self._hot_item_keys[0]

    @property
    def hot_products(self) -> HotKeys:
        return self._hot_item_keys[1]

    # -- the calendar ----------------------------------------------------------

    @cached_property
    def month_mask(self) -> MonthMask:
        """Room for the months that orders can have, from one narrow scan."""
        return self._months_of(self.orders, "order_date_only")

    @staticmethod
    def _months_of(df: DataFrame, date: str) -> MonthMask:
        month = month_number(F.col(date))
        found = df.agg(F.min(month), F.max(month)).first()
        return MonthMask(0, 0) if found[0] is None else MonthMask(*found)

    # -- grains that several analyses share -------------------------------------

    def customer_totals(self) -> DataFrame:
        """Completed orders per customer; combined map-side, so no customer is hot."""
        return self.completed().groupBy("customer_id").agg(*self._customer_sums())

    @staticmethod
    def _customer_sums() -> list[Column]:
        return [
            F.min("order_date_only").alias("first_order_date"),
            F.max("order_date_only").alias("last_order_date"),
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("lifetime_spend"),
            F.sum("gross_profit").alias("lifetime_gross_profit"),
        ]

    def customer_months(self, status: str) -> DataFrame:
        """The months in which each customer has orders of a status, as a mask."""
        month = month_number(F.col("order_date_only")).alias("month_no")
        orders = self.orders_with(status).select("customer_id", month)
        return orders.groupBy("customer_id").agg(*self.month_mask.aggregates(F.col("month_no")))

    @staticmethod
    def _order_sums() -> list[Column]:
        return [
            F.count("*").alias("total_orders"),
            F.countDistinct("customer_id").alias("active_customers"),
            F.sum("total_amount").alias("gross_revenue"),
            F.sum("discount_amount").alias("total_discounts"),
            F.sum("gross_profit").alias("total_gross_profit"),
        ]

    def totals(self) -> DataFrame:
        """One row over all completed orders."""
        return self.completed().agg(*self._order_sums())

    def month_totals(self) -> DataFrame:
        """The same per ``month_no``."""
        month = month_number(F.col("order_date_only")).alias("month_no")
        return self.completed().groupBy(month).agg(*self._order_sums())

    def sold_products(self) -> DataFrame:
        """One row per completed order and product: ``sales, profit, units``. Less to move
        to the products than lines, and the distinct orders stay countable. The lines are
        dealt by their number, since nearly each is a group that a task holds."""
        items = self.order_items.select("order_id", "product_id", "quantity", "line_subtotal", "line_cost")
        hot = self.hot_orders
        sold = salted_join(
            items, self.completed_keys(), "order_id", hot, ["product_id"], how="left_semi", tasks=hot.tasks()
        )
        return sold.groupBy("order_id", "product_id").agg(
            F.sum("line_subtotal").alias("sales"),
            F.sum(F.col("line_subtotal") - F.col("line_cost")).alias("profit"),
            F.sum("quantity").alias("units"),
        )

    def stored_sold_products(self) -> DataFrame | None:
        """``sold_products`` where they are stored already."""
        return None

    # -- order sequence --------------------------------------------------------

    @property
    def has_sequence(self) -> bool:
        return "order_sequence" in self.orders.columns

    def sequenced_orders(self, orders: DataFrame | None = None) -> DataFrame:
        """Orders of every status with ``order_sequence``."""
        orders = self.orders if orders is None else orders
        if "order_sequence" in orders.columns:
            return orders
        return ordered_scan(
            orders,
            "customer_id",
            ORDER_OF_SEQUENCE,
            self.hot_customers,
            count="order_sequence",
        )

    def first_orders(self, k: int) -> DataFrame:
        """Orders with sequence 1..k. The rank limit also runs before the shuffle
        (WindowGroupLimit), so no task receives more than k rows per customer and
        map task, however many orders a customer has."""
        if self.has_sequence:
            return self.orders.where(F.col("order_sequence") <= k)
        ordered = W.partitionBy("customer_id").orderBy(*ORDER_OF_SEQUENCE)
        return self.orders.withColumn(
            "order_sequence", F.row_number().over(ordered)
        ).where(F.col("order_sequence") <= k)

    # -- names -----------------------------------------------------------------

    def create_views(self, prefix: str = "") -> None:
        for name in ("customers", "products", "orders", "order_items"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
