"""How often tables are read, and with what operators: over all plans a query runs, the
stored steps included."""

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import SHOP, money, rows, shop
from tillroll.operators import scratch
from tillroll.plans import active, catalog, cohort, quality
from tillroll.sources.tables import RetailTables

QUERIES = catalog.queries()


@pytest.fixture
def plans_of(spark, sf_dir, monkeypatch):
    """The plans of every step that is written, and of the result."""
    import sys

    written = []
    original = scratch.materialize

    def recording(df, label):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, label)

    for name, module in list(sys.modules.items()):
        if name.startswith("tillroll.") and getattr(module, "materialize", None) is original:
            monkeypatch.setattr(module, "materialize", recording)

    def run(query):
        written.clear()
        result = QUERIES[query](spark, sf_dir)
        return [*written, result._jdf.queryExecution().executedPlan().toString()]

    return run


def _scans(plans, table):
    return sum(len(re.findall(rf"FileScan parquet .*{table}\.parquet", plan)) for plan in plans)


@pytest.mark.parametrize("query, most", [
    ("dashboard_payload", 2),
    ("test_results_table", 1),
    ("hypothesis_p_values", 1),
    ("lod_customer_fields", 1),
    ("market_basket_pairs", 1),
    ("top_pairs_dashboard", 1),
    ("cohort_matrix_dashboard", 1),
    ("active_customers_rollup", 1),
    ("dq_keys", 2),  # orders are sums of lines here, and the lines themselves
])
def test_line_scans(plans_of, query, most):
    assert 1 <= _scans(plans_of(query), "lineitem") <= most


@pytest.mark.parametrize("query", ["cohort_retention", "cohort_matrix_dashboard"])
def test_cohorts_need_no_object_aggregate(plans_of, query):
    plans = "\n".join(plans_of(query))
    assert "ObjectHashAggregate" not in plans and "SortAggregate" not in plans
    assert "collect_set" not in plans and "HashAggregate" in plans


def _counting(spark, t):
    """The tables, and how many rows of each have been read."""
    seen = {}

    def counted(name):
        df = getattr(t, name)
        seen[name] = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    return RetailTables(*[counted(n) for n in ("customers", "products", "orders", "order_items")]), seen


def test_key_checks_read_each_table_once(spark):
    t = shop(spark)
    counting, seen = _counting(spark, t)
    checks = quality.dq_keys(counting)
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.check_type, r.table_name, r.column_name): r.violations for r in checks.collect()}
    assert not any(got.values()) and len(got) == 7 + 2 + 5 + 10 + 8
    assert {n: a.value for n, a in seen.items()} == {n: getattr(t, n).count() for n in seen}


def test_key_checks_count_violations(spark):
    t = shop(spark)
    t.orders = t.orders.unionByName(t.orders.where("order_id in ('O1', 'O2')"))
    t.orders = t.orders.withColumn("customer_id", F.when(F.col("order_id") != "O3", F.col("customer_id")))
    t.orders = t.orders.withColumn("customer_id", F.when(F.col("order_id") == "O6", "C9").otherwise(F.col("customer_id")))
    t.order_items = t.order_items.withColumn("order_id", F.when(F.col("order_id") == "O1", "OX").otherwise(F.col("order_id")))
    t.products = t.products.where("product_id <> 2").unionByName(t.products.where("product_id = 3"))
    got = {(r.check_type, r.table_name, r.column_name): r.violations for r in quality.dq_keys(t).collect() if r.violations}
    twos = sum(p == 2 for *_, products in SHOP for p in products)
    assert got == {
        ("primary_key", "orders", "order_id"): 2,
        ("primary_key", "products", "product_id"): 1,
        ("foreign_key", "orders", "customer_id"): 1,
        ("foreign_key", "order_items", "order_id"): 3,
        ("foreign_key", "order_items", "product_id"): twos,
        ("not_null", "orders", "customer_id"): 1,
    }


def _orders_of(months):
    """One order per (customer, month number)."""
    return [
        (f"O{i}", c, dt.date(m // 12, m % 12 + 1, 1 + i % 28).isoformat(), "Completed", i + 1, 10, 4, [1])
        for i, (c, m) in enumerate(months)
    ]


@pytest.mark.parametrize("span", [1, 63, 64, 65, 130, 300])
def test_cohorts_over_many_words(spark, span):
    first = 1990 * 12 + 5
    months = [(f"C{c}", first + (c * 7 + k * k * 11) % span) for c in range(6) for k in range(8)]
    months += [("C0", first), ("C1", first + span - 1)]
    t = shop(spark, _orders_of(months), channels={f"C{c}": "Email" for c in range(6)})
    active_in = {}
    for c, m in months:
        active_in.setdefault(c, set()).add(m)
    expected = Counter((min(of), m - min(of)) for of in active_in.values() for m in of)
    label = lambda n: f"{n // 12}-{n % 12 + 1:02d}"
    got = cohort.cohort_retention(t).select("cohort_month", "month_offset", "active_customers")
    assert {tuple(r)[:2]: r[2] for r in rows(got)} == {(label(c), o): n for (c, o), n in expected.items()}


@pytest.mark.parametrize("number", [False, True])
def test_active_customers_at_every_level(spark, number):
    """Customers named by text and by number, more than one bitmap of them."""
    n = 40_000 if number else 300
    t = shop(spark)
    ids = F.col("id") if number else F.concat(F.lit("K"), F.col("id"))
    day = F.expr("date_add(date'2023-11-15', cast(id * 13 % 300 as int))")
    base = spark.range(3 * n).select(
        F.col("id").cast("string").alias("order_id"),
        (F.col("id") % n).alias("id"),
        day.alias("order_date_only"),
        F.when(F.col("id") % 11 == 0, "Returned").otherwise("Completed").alias("order_status"),
        F.lit(money(1)).alias("total_amount"),
    )
    t.orders = base.withColumn("customer_id", ids)
    t.customers = spark.range(n).withColumn("customer_id", ids).withColumn("region", F.concat(F.lit("R"), F.col("id") % 3))
    done = t.orders.where("order_status = 'Completed'").join(t.customers.select("customer_id", "region"), "customer_id")
    done = done.selectExpr("*", "year(order_date_only) y", "month(order_date_only) m")
    got = {(r.level, r.region, r.sales_year, r.sales_month): (r.active_customers, r.orders) for r in active.active_customers_rollup(t).collect()}
    short = {"region": "region", "sales_year": "y", "sales_month": "m"}
    expected = {}
    for level, cut in active.LEVELS.items():
        keys = [short[c] for c in cut]
        for r in done.groupBy(*keys).agg(F.countDistinct("customer_id").alias("c"), F.count("*").alias("n")).collect():
            of = r.asDict()
            expected[(level, of.get("region"), of.get("y"), of.get("m"))] = (r.c, r.n)
    assert got == expected


def test_month1_retention_of_cohorts_nobody_came_back_in(spark):
    first = 2024 * 12
    months = [("C0", first), ("C1", first), ("C0", first + 1), ("C2", first + 3), ("C3", first + 6)]
    t = shop(spark, _orders_of(months), channels={f"C{c}": "Email" for c in range(4)})
    # of the cohorts of month 0, 3 and 6 the first shows half, the second none, the last is too young
    assert rows(cohort.avg_month1_retention_all(t)) == [(2, 25.0, 33.33)]
    assert rows(cohort.avg_month1_retention(t)) == [(1, 50.0, 50.0)]
