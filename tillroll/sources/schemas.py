"""Declared schemas of the retail tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# The order states.
COMPLETED, RETURNED, CANCELLED = "Completed", "Returned", "Cancelled"

_PRICE = DecimalType(10, 2)
_MONEY = DecimalType(18, 2)


def _struct(**columns) -> StructType:
    """Column name -> type; a tuple (type,) marks a NOT NULL column."""
    return StructType(
        [
            StructField(name, t[0], False)
            if isinstance(t, tuple)
            else StructField(name, t, True)
            for name, t in columns.items()
        ]
    )


CUSTOMERS = _struct(
    customer_id=(StringType(),),
    first_name=StringType(),
    email=StringType(),
    signup_date=(DateType(),),
    region=StringType(),
    acquisition_channel=StringType(),
)

PRODUCTS = _struct(
    product_id=(IntegerType(),),
    product_name=(StringType(),),
    category=(StringType(),),
    unit_price=(_PRICE,),
    unit_cost=(_PRICE,),
    margin_percentage=DoubleType(),
)

ORDERS = _struct(
    order_id=(StringType(),),
    customer_id=(StringType(),),
    order_date=(TimestampNTZType(),),
    order_date_only=(DateType(),),
    order_status=(StringType(),),
    payment_method=StringType(),
    subtotal=(_MONEY,),
    discount_amount=_MONEY,
    shipping_fee=_MONEY,
    total_amount=(_MONEY,),
    total_cost=(_MONEY,),
    gross_profit=(_MONEY,),
    order_sequence=(IntegerType(),),
)

ORDER_ITEMS = _struct(
    item_id=(StringType(),),
    order_id=(StringType(),),
    product_id=(IntegerType(),),
    quantity=(IntegerType(),),
    unit_price=(_MONEY,),
    unit_cost=(_MONEY,),
    line_subtotal=(_MONEY,),
    line_cost=(_MONEY,),
)

SCHEMAS = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "item_id",
}

# child table, child column, parent table (its primary key has the same name)
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
]

# Columns whose declaration carries DEFAULT 0.00
DEFAULT_ZERO = {"orders": ["discount_amount", "shipping_fee"]}
