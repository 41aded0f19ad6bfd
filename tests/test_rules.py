"""All 125 score combinations through the segment rules."""

import itertools

import pytest

from tillroll.plans.rfm import DASHBOARD_RULES, FIVE_SEGMENT_RULES, SEGMENT_RULES, segment


def _expected(r, f, m, five, new):
    if r > 3 and f > 3 and m > 3:
        return "Champions"
    if r > 2 and f > 2:
        return "Loyal Customers"
    if r > 3 and f < 3:
        return new
    if not five and r == 3 and f < 3 and m > 2:
        return "Potential Loyalists"
    if r < 3 and f > 2:
        return "At Risk Customers"
    if not five and r < 3 and f < 3 and m > 2:
        return "High-Value Dormant"
    return "Lost / Hibernating"


@pytest.mark.parametrize(
    "rules, five, new",
    [
        (SEGMENT_RULES, False, "Promising New Customers"),
        (DASHBOARD_RULES, False, "Promising New"),
        (FIVE_SEGMENT_RULES, True, "Promising New"),
    ],
)
def test_cells(spark, rules, five, new):
    cells = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(cells, "r_score int, f_score int, m_score int")
    got = df.select("*", segment(rules).alias("s")).collect()
    assert {tuple(r)[:3]: r.s for r in got} == {
        c: _expected(*c, five, new) for c in cells
    }
