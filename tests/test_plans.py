"""Shape of the physical plans: what must not come back unnoticed."""

import re

import pytest

from tillroll.plans import catalog

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def plan_of(spark, sf_dir):
    """Plans as for large tables: nothing is small enough to broadcast by size."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def plan(name):
        df = QUERIES[name](spark, sf_dir)
        return df._jdf.queryExecution().executedPlan().toString()

    yield plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(plan_of, name):
    plan = plan_of(name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_status_filter_reaches_the_scan(plan_of):
    plan = plan_of("repeat_customer_rate")
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "EqualTo(o_orderstatus,F)" in orders
    assert "o_totalprice" not in orders and "o_orderpriority" not in orders
    lines = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "ReadSchema: struct<l_orderkey:bigint>" in lines


@pytest.mark.parametrize("name", ["interpurchase_by_transition", "repurchase_funnel"])
def test_first_orders_are_limited_before_the_shuffle(plan_of, name):
    plan = plan_of(name)
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    assert re.search(r"WindowGroupLimit .*Final", plan)


def test_scoring_moves_no_rows(plan_of):
    assert "Exchange" not in plan_of("rfm_scores")


def _exchanges(plan, column):
    return len(re.findall(rf"Exchange hashpartitioning\({column}#\d+L?,", plan))


def test_cohorts_move_customers_once(plan_of):
    assert _exchanges(plan_of("cohort_retention"), "customer_id") == 1


def test_running_spend_moves_orders_once_per_key(plan_of):
    plan = plan_of("running_spend")
    assert _exchanges(plan, "customer_id") == 1
    assert plan.count("Exchange") == 3  # orders and their totals, then customers


def test_master_moves_lines_once_per_join(plan_of):
    plan = plan_of("analytics_master")
    # lines and products; orders by customer; both sides of the order join
    assert _exchanges(plan, "product_id") == 2
    assert _exchanges(plan, "order_id") == 3


def test_pairs_are_generated_in_place(plan_of):
    plan = plan_of("market_basket_pairs")
    assert plan.count("Generate posexplode") == 1
    assert "TakeOrderedAndProject" in plan
