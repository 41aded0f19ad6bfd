"""Sources, sinks and views."""

import datetime as dt
import json

import pytest

from fixtures import rows, shop
from tillroll.plans import cohort, export, sales
from tillroll.sources import files, sinks
from tillroll.sources.schemas import PRODUCTS, SCHEMAS


def test_csv_round_trip(spark, tmp_path):
    t = shop(spark)
    export.write_retail_csv(t, str(tmp_path))
    back = files.load_csv_tables(spark, str(tmp_path))
    for name in SCHEMAS:
        got, want = getattr(back, name), getattr(t, name)
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
    assert rows(sales.executive_kpis(back)) == rows(sales.executive_kpis(t))


def test_csv_header_is_checked(spark, tmp_path):
    path = str(tmp_path / "products.csv")
    sinks.write_csv(shop(spark).products.select(*reversed(PRODUCTS.fieldNames())), path)
    with pytest.raises(Exception):
        files.read_csv_table(spark, path, "products").collect()


def test_parquet_tables(spark, tmp_path):
    t = shop(spark)
    export.write_retail_parquet(t, str(tmp_path))
    assert len(spark.read.parquet(f"{tmp_path}/analytics_master").columns) == 30
    back = files.load_parquet_tables(spark, str(tmp_path))
    assert rows(sales.executive_kpis(back)) == rows(sales.executive_kpis(t))
    with pytest.raises(ValueError):
        files.conform(t.orders.drop("order_status"), "orders")


def test_defaults(spark):
    orders = shop(spark).orders.selectExpr(
        "* except (discount_amount)", "cast(null as decimal(18,2)) as discount_amount"
    )
    assert {r.discount_amount for r in files.conform(orders, "orders").collect()} == {0}


def test_replacing_table(spark):
    t = shop(spark)
    sinks.write_table(t.products, "tillroll_products")
    sinks.write_table(t.products.limit(1), "tillroll_products")
    assert spark.table("tillroll_products").count() == 1
    spark.sql("drop table tillroll_products")


def test_bucketed_tables_join_in_place(spark):
    t = shop(spark)
    export.write_retail_tables(t, "till_", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("till_order_items").join(spark.table("till_orders"), "order_id")
        assert joined.count() == 11
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stored = files.load_catalog_tables(spark, "till_")
    assert rows(sales.executive_kpis(stored)) == rows(sales.executive_kpis(t))
    for name in [*SCHEMAS, "analytics_master"]:
        spark.sql(f"drop table till_{name}")


def test_views(spark):
    t = shop(spark)
    t.create_views("shop_")
    n = spark.sql("select count(*) from shop_orders where order_status = 'Completed'")
    assert n.first()[0] == 5


def test_report_views(spark):
    sales.create_report_views(shop(spark))
    assert spark.table("vw_customer_order_summary").count() == 3
    months = spark.sql("select sum(total_orders) from vw_monthly_sales_summary")
    assert months.first()[0] == 5


def test_csv_as_written_by_other_tools(spark, tmp_path):
    """Unquoted text, float spelling of amounts, a space in the timestamp."""
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,order_date,order_date_only,order_status,payment_method,"
        "subtotal,discount_amount,shipping_fee,total_amount,total_cost,gross_profit,"
        "order_sequence\n"
        "ORD-000001,CUST-00001,2024-01-05 10:20:30,2024-01-05,Completed,PayPal,"
        "159.98000000000002,,4.99,164.97,71.0,88.98,1\n"
    )
    (row,) = rows(files.read_csv_table(spark, str(tmp_path / "orders.csv"), "orders"))
    assert row[2:8] == (
        dt.datetime(2024, 1, 5, 10, 20, 30), dt.date(2024, 1, 5), "Completed", "PayPal",
        159.98, 0.0,
    )
    (tmp_path / "products.csv").write_text(
        "product_id,product_name,category,unit_price,unit_cost,margin_percentage\n"
        "7,Wool Hat (Grey),Clothes,24.0,6.0,75.0\n"
        '8,"Pan, 20 cm",Kitchen & More,59.99,20.0,66.66\n'
    )
    products = files.read_csv_table(spark, str(tmp_path / "products.csv"), "products")
    assert rows(products)[1] == (8, "Pan, 20 cm", "Kitchen & More", 59.99, 20.0, 66.66)


def test_results_file(spark, sf_dir, tmp_path):
    from tillroll.sources.tpch import load_tpch_tables

    path = str(tmp_path / "results.csv")
    export.write_test_results(load_tpch_tables(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == [
        "hypothesis", "test_type", "statistic", "p_value", "verdict", "business_takeaway",
    ]
    assert back.count() == 3


def test_document(spark, tmp_path):
    path = str(tmp_path / "dashboard")
    export.write_dashboard(shop(spark), path)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert json.loads(text)["kpis"]["total_orders"] == 5


def test_stored_tables_give_the_same_results(spark, sf_dir, tmp_path):
    from tillroll.plans import lifecycle
    from tillroll.sources.tpch import load_tpch_tables

    derived = load_tpch_tables(spark, sf_dir)
    export.write_retail_parquet(derived, str(tmp_path))
    stored = files.load_parquet_tables(spark, str(tmp_path))
    for analysis in (
        sales.executive_kpis,
        cohort.cohort_retention,
        lifecycle.repurchase_funnel,
        lifecycle.interpurchase_by_transition,
        sales.channel_distribution,
    ):
        assert rows(analysis(stored)) == rows(analysis(derived))
