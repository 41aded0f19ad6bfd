"""Pair counts with orders too wide to expand, against brute force."""

import itertools
import random
import re
from collections import Counter
from dataclasses import replace

import pandas as pd
import pytest

from fixtures import shop
from tillroll.operators import skew
from tillroll.operators.scratch import materialize
from tillroll.plans import basket


def _orders(seed, n, wide, products):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = wide[i] if i < len(wide) else rng.randrange(1, 5)
        lines = [rng.randrange(products) for _ in range(size)]
        status = "Returned" if i % 7 == 6 else "Completed"
        out.append((f"O{i}", "C1", "2024-01-10", status, i + 1, 10, 4, lines))
    return out


def _brute(orders, least, top_k):
    pairs, singles, n = Counter(), Counter(), 0
    for *_, status, _, _, _, lines in orders:
        if status == "Completed":
            n += 1
            members = sorted(set(lines))
            singles.update(members)
            pairs.update(itertools.combinations(members, 2))
    kept = sorted(((-c, a, b) for (a, b), c in pairs.items() if c >= least))[:top_k]
    return [(a, b, -c, singles[a], singles[b]) for c, a, b in kept], n


def _got(df):
    return [
        (r.product_a_id, r.product_b_id, r.times_bought_together,
         r.orders_with_product_a, r.orders_with_product_b)
        for r in df.collect()
    ]


@pytest.mark.parametrize(
    "wide, products, least, top_k",
    [
        ([60], 25, 2, 20),  # one wide order, as large as a third of all lines
        ([60], 25, 1, 10),
        ([40, 45, 50], 60, 2, 20),  # more wide orders than the threshold
        ([40, 45, 50, 40, 30, 30], 40, 3, None),
        ([30] * 8, 400, 2, 50),  # pairs that only wide orders have
        ([30] * 8, 400, 1, 5),
        ([], 25, 2, 20),
    ],
)
def test_wide_orders(spark, wide, products, least, top_k):
    orders = _orders(len(wide) + products, 60, wide, products)
    t = shop(spark, orders, channels={"C1": "Email"})
    got = basket.market_basket_pairs(t, least, top_k, max_width=12)
    expected, _ = _brute(orders, least, top_k)
    assert _got(got) == expected
    assert _got(basket.market_basket_pairs(t, least, top_k)) == expected


def test_agrees_with_fp_growth(spark):
    from pyspark.ml.fpm import FPGrowth

    orders = [o for o in _orders(11, 60, [], 9) if o[3] == "Completed"]
    sets = spark.createDataFrame([(sorted(set(o[-1])),) for o in orders], "items array<int>")
    found = FPGrowth(minSupport=2 / len(orders)).fit(sets).freqItemsets.collect()
    pairs = {tuple(sorted(r["items"])): r.freq for r in found if len(r["items"]) == 2}
    ours = basket.market_basket_pairs(shop(spark, orders, channels={"C1": "Email"}), 2, None)
    assert {(a, b): n for a, b, n, *_ in _got(ours)} == pairs


def test_hot_order(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    orders = _orders(5, 40, [80, 20], 30)
    t = shop(spark, orders, channels={"C1": "Email"})
    for top_k in (20, None):
        got = basket.market_basket_pairs(t, 2, top_k, max_width=12)
        assert _got(got) == _brute(orders, 2, top_k)[0]


@pytest.mark.parametrize("max_width", [12, 200])
def test_products_without_a_name_take_no_place(spark, max_width):
    """The best pair holds a product that the product table lacks."""
    lines = [[1, 2]] * 5 + [[2, 3]] * 4 + [[2, 3, *range(10, 25)]] + [[3, 4]] * 2
    orders = [
        (f"O{i}", "C1", "2024-01-10", "Completed", i + 1, 10, 4, products)
        for i, products in enumerate(lines)
    ]
    t = shop(spark, orders, channels={"C1": "Email"})
    t.products = t.products.where("product_id <> 1")
    assert _got(basket.market_basket_pairs(t, 1, 1, max_width=max_width)) == [(2, 3, 5, 10, 7)]
    top = basket.top_pairs_dashboard(t, 1, max_width=max_width).collect()
    assert [(r.p1_name, r.p2_name, r.co_orders) for r in top] == [("P2", "P3", 5)]


def _input(spark, baskets, known=None):
    """Baskets by order number; every seventh order does not count."""
    lines = [(o, p) for o, products in baskets.items() for p in products]
    orders = spark.createDataFrame([(o,) for o in baskets if o % 7 != 6], "order_id int")
    products = sorted({p for of in baskets.values() for p in of if known is None or p in known})
    return basket.BasketInput(
        spark.createDataFrame(pd.DataFrame(lines, columns=["order_id", "product_id"])).repartition(6),
        orders,
        orders,
        spark.createDataFrame([(p, f"P{p}", "c") for p in products], "product_id long, product_name string, category string"),
    )


def _expected(baskets, least, top_k, known=None):
    """Brute force; pairs that only the one very wide order has occur once."""
    sets = {o: {p for p in s if known is None or p in known} for o, s in baskets.items() if o % 7 != 6}
    widest = max(sets, key=lambda o: len(sets[o]))
    pairs, singles = Counter(), Counter()
    for o, members in sets.items():
        singles.update(members)
        if o != widest:
            pairs.update(itertools.combinations(sorted(members), 2))
    for a, b in pairs:
        pairs[a, b] += a in sets[widest] and b in sets[widest]
    kept = sorted((-c, a, b) for (a, b), c in pairs.items() if c >= least)[:top_k]
    return [(a, b, -c, singles[a], singles[b]) for c, a, b in kept]


def _very_wide(rng):
    baskets = {0: range(100_000)}
    for o in range(1, 9):  # more wide orders than the threshold
        baskets[o] = rng.sample(range(5_000), 260) + [7, 8, 9]
    for o in range(9, 400):
        baskets[o] = [rng.randrange(3_000) for _ in range(rng.randrange(1, 6))]
    return {o: sorted(set(s)) for o, s in baskets.items()}


@pytest.mark.parametrize("rows_per_task", [2_000_000, 3_000])
def test_an_order_of_a_hundred_thousand_products(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", rows_per_task)
    baskets = _very_wide(random.Random(4))
    source = _input(spark, baskets)
    got = basket.market_basket_pairs(None, 2, None, source=source)
    assert _got(got) == _expected(baskets, 2, None)
    assert _got(basket.market_basket_pairs(None, 3, 15, source=source)) == _expected(baskets, 3, 15)


@pytest.mark.parametrize("limit", [250_000, 0])
def test_hot_and_unknown_products(spark, monkeypatch, limit):
    """Product 7 has a third of the lines; unknown products are dropped, by broadcast or not."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rng = random.Random(8)
    baskets = {o: sorted({7, *(rng.randrange(60) for _ in range(40 if o % 9 == 0 else 3))}) for o in range(300)}
    known = set(range(60)) - {3, 11}
    source = _input(spark, baskets, known)
    for least, top_k in ((2, None), (2, 20), (4, None)):
        got = basket.market_basket_pairs(None, least, top_k, max_width=12, source=source)
        assert _got(got) == _expected(baskets, least, top_k, known)


def _written_plans(monkeypatch):
    plans = []

    def recording(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    for module in (basket, skew):
        monkeypatch.setattr(module, "materialize", recording)
    return plans


def _below(plan, pattern):
    """What stands under each exchange that matches, down to the next exchange."""
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if re.search(pattern, line):
            depth, under = len(line) - len(line.lstrip(" :+-*()0123456789")), []
            for below in lines[at + 1 :]:
                if len(below) - len(below.lstrip(" :+-*()0123456789")) <= depth or "Exchange" in below:
                    break
                under.append(below)
            yield "\n".join(under)


def test_lines_are_read_once_and_never_dealt_by_product(spark, monkeypatch):
    plans = _written_plans(monkeypatch)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        source = _input(spark, {o: [7, o % 50, o % 31] for o in range(600)})
        seen = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        lines = source.lines.mapInArrow(counted, source.lines.schema)
        result = basket.market_basket_pairs(None, 2, 20, source=replace(source, lines=lines))
        plans.append(result._jdf.queryExecution().executedPlan().toString())
        assert result.count() == 20
        assert seen.value == source.lines.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [under for plan in plans for under in _below(plan, r"Exchange hashpartitioning\(product_id#\d+L?,")]
    assert dealt
    for under in dealt:  # counts per product, or the products themselves
        assert "HashAggregate" in under or "order_id" not in under
