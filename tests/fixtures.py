"""A hand-made shop of four customers and seven orders."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tillroll.sources.schemas import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS
from tillroll.sources.tables import RetailTables

# order, customer, date, status, sequence, total, profit, products per line
SHOP = [
    ("O1", "C1", "2024-01-10", "Completed", 1, 100, 40, [1, 2, 2]),
    ("O2", "C1", "2024-03-15", "Completed", 2, 50, 20, [1]),
    ("O3", "C2", "2024-01-31", "Completed", 1, 80, 30, [1, 2]),
    ("O4", "C2", "2024-02-01", "Returned", 2, 70, 25, [1, 2]),
    ("O5", "C2", "2024-02-29", "Completed", 3, 20, 8, [2]),
    ("O6", "C3", "2024-02-05", "Cancelled", 1, 60, 20, [3]),
    ("O7", "C3", "2024-03-15", "Completed", 2, 40, 10, [3]),
]
CHANNELS = {"C1": "Email", "C2": "Referral", "C3": "Email", "C4": "Referral"}


def money(x) -> Decimal:
    return Decimal(x).quantize(Decimal("0.01"))


def shop(spark, orders=SHOP, stored_sequence=True, channels=CHANNELS) -> RetailTables:
    day = dt.date.fromisoformat
    rows = []
    for o, c, d, status, seq, total, profit, _ in orders:
        at = dt.datetime.combine(day(d), dt.time(9, 30))
        rows.append(
            (o, c, at, day(d), status, "PayPal", money(total), money(0), money(0),
             money(total), money(total - profit), money(profit), seq)
        )
    order_df = spark.createDataFrame(rows, ORDERS)
    if not stored_sequence:
        order_df = order_df.drop("order_sequence")
    items, n = [], 0
    for o, *_, products in orders:
        for p in products:
            n += 1
            items.append((f"I{n}", o, p, 1, money(10), money(4), money(10), money(4)))
    products = sorted({p for *_, ps in orders for p in ps})
    return RetailTables(
        customers=spark.createDataFrame(
            [(c, c.lower(), None, day("2024-01-01"), "North", ch) for c, ch in channels.items()],
            CUSTOMERS,
        ),
        products=spark.createDataFrame(
            [(p, f"P{p}", "Odd" if p % 2 else "Even", money(10), money(4), 60.0) for p in products],
            PRODUCTS,
        ),
        orders=order_df,
        order_items=spark.createDataFrame(items, ORDER_ITEMS),
    )


def rows(df) -> list[tuple]:
    return [
        tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()
    ]
