"""Tables whose orders are derived once and stored for several analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.functions.dates import MonthMask
from tillroll.operators.scratch import materialize
from tillroll.operators.skew import HotKeys
from tillroll.sources.tables import RetailTables

#: What the reports ask of an order, besides its sequence and line count where it has them.
_COLUMNS = [
    "order_id",
    "customer_id",
    "order_date",
    "order_date_only",
    "order_status",
    "total_amount",
    "discount_amount",
    "gross_profit",
]


class StoredOrders(RetailTables):
    """The tables of ``t`` with its orders, or those of one ``status``, written once."""

    def __init__(self, t: RetailTables, status: str | None = None):
        orders = t.orders if status is None else t.orders_with(status)
        more = [c for c in ("order_sequence", "line_count") if c in orders.columns]
        self._t, self.orders = t, materialize(orders.select(*_COLUMNS, *more), "orders")

    def __getattr__(self, name):
        return getattr(self._t, name)

    def completed_keys(self) -> DataFrame:
        return self._t.completed_keys()

    @property
    def customer_attributes(self) -> DataFrame:
        return self._t.customer_attributes

    @property
    def month_mask(self) -> MonthMask:
        return self._t.month_mask

    @property
    def hot_customers(self) -> HotKeys:
        return self._t.hot_customers

    @property
    def hot_orders(self) -> HotKeys:
        return self._t.hot_orders

    @property
    def hot_products(self) -> HotKeys:
        return self._t.hot_products
