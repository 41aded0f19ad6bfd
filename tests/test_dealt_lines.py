"""Lines that a grouping holds in memory are dealt by their number."""

import re

import pytest

from fixtures import rows, shop
from tillroll.operators import skew
from tillroll.plans import sales

MANY = [(f"O{k}", "C1", "2024-01-10", "Returned" if k % 5 == 0 else "Completed", k, 30, 9, [k % 7, 1, 2]) for k in range(60)]


def partitions(df) -> set[int]:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return {int(n) for n in re.findall(r"Repartition\w* .*?, (\d+)", plan) + re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)}


@pytest.mark.parametrize("hot", [False, True])
def test_tasks_follow_the_number_of_lines(spark, monkeypatch, hot):
    plain = sorted(rows(sales.category_performance(shop(spark, MANY))))
    monkeypatch.setattr(skew, "HELD_ROWS", 10)
    if hot:  # products 1 and 2 and every order with three lines
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 2)
    tables = shop(spark, MANY)
    assert tables.hot_orders.tasks() == 18 and bool(tables.hot_orders) == hot
    sold = tables.sold_products()
    assert 18 in partitions(sold)
    assert sold.count() == sum(len(set(o[-1])) for o in MANY if o[3] == "Completed")
    assert sorted(rows(sales.category_performance(shop(spark, MANY)))) == plain
