"""The dashboard document and the written exports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.dates import month_number
from tillroll.operators.scratch import materialize, scratch_path
from tillroll.plans import basket, bi, cohort, lifecycle, rfm, sales, stats
from tillroll.sources import files, sinks
from tillroll.sources.schemas import COMPLETED, PRODUCTS
from tillroll.sources.stored import StoredOrders
from tillroll.sources.tables import RetailTables


class _Shared(StoredOrders):
    """The same tables with the grains that the sections share, each stored once.

    The lines are read twice: summed up to completed orders, and to products of completed
    orders. The stored orders feed two more grains, from one scan each: months with the
    total beside them (``GROUPING SETS``), and customers with their months as a mask.
    """

    def __init__(self, t: RetailTables):
        super().__init__(t, COMPLETED)

    @cached_property
    def _periods(self) -> DataFrame:
        month = month_number(F.col("order_date_only")).alias("month_no")
        grouped = self.orders.select("*", month).groupingSets([["month_no"], []], "month_no")
        sums = grouped.agg(F.grouping_id().alias("level_no"), *self._order_sums())
        return materialize(sums, "periods")

    def month_totals(self) -> DataFrame:
        return self._periods.where("level_no = 0").drop("level_no")

    def totals(self) -> DataFrame:
        """No orders make no total row, which then is one of zeros and nulls."""
        total = F.col("level_no") == 1
        of = lambda c: F.max(F.when(total, F.col(c)))
        counts = [F.coalesce(of(c), F.lit(0)).alias(c) for c in ("total_orders", "active_customers")]
        sums = ("gross_revenue", "total_discounts", "total_gross_profit")
        return self._periods.agg(*counts, *[of(c).alias(c) for c in sums])

    @cached_property
    def _customers(self) -> DataFrame:
        month = month_number(F.col("order_date_only")).alias("month_no")
        per_customer = self.orders.select("*", month).groupBy("customer_id")
        masks = self.month_mask.aggregates(F.col("month_no"))
        return materialize(per_customer.agg(*self._customer_sums(), *masks), "customers")

    def customer_totals(self) -> DataFrame:
        return self._customers.drop("cohort_no", "until", *self.month_mask.columns)

    def customer_months(self, status: str) -> DataFrame:
        return self._customers if status == COMPLETED else super().customer_months(status)

    @cached_property
    def _sold(self) -> DataFrame:
        return materialize(self._t.sold_products(), "sold")

    def sold_products(self) -> DataFrame:
        return self._sold

    def stored_sold_products(self) -> DataFrame | None:
        return self._sold


# The section names of the document. A record section has one row; a
# list section has the columns its rows are ordered by, minus for descending.
_RECORDS = {
    "kpis": sales.executive_kpis,
    "repeat_rate": lifecycle.repeat_customer_rate,
}
_LISTS = {
    "monthly_trend": (sales.monthly_trend, ["month"]),
    "category_performance": (sales.category_performance, ["-total_sales", "category"]),
    "cohort_matrix": (cohort.cohort_matrix_dashboard, ["cohort_month", "cohort_index"]),
    "rfm_segments": (rfm.rfm_dashboard, ["-total_revenue", "segment"]),
    "market_basket": (
        basket.top_pairs_dashboard,
        ["-co_orders", "p1_name", "p2_name", "p1_cat", "p2_cat"],
    ),
    "channels": (sales.channel_distribution, ["-revenue", "acquisition_channel"]),
}


def _record(df: DataFrame):
    return df.select(F.struct("*")).scalar()


def _records(df: DataFrame, order: list[str]):
    """A section's rows, a report of months, segments, channels or top pairs, as one
    ordered array."""
    key = [
        -F.col(c[1:]).cast("double") if c.startswith("-") else F.col(c) for c in order
    ]
    rows = F.array_sort(
        F.collect_list(F.struct(F.struct(*key).alias("k"), F.struct("*").alias("row")))
    )
    return df.select(rows.getField("row")).scalar()


def dashboard_payload(t: RetailTables) -> DataFrame:
    """One row, one column: the document of all sections as indented JSON."""
    t = _Shared(t)
    sections = [_record(fn(t)).alias(name) for name, fn in _RECORDS.items()]
    sections += [
        _records(fn(t), order).alias(name) for name, (fn, order) in _LISTS.items()
    ]
    one_row = t.completed().sparkSession.range(1)
    return one_row.select(
        F.to_json(F.struct(*sections), _JSON).alias("document")
    )


_JSON = {"pretty": "true", "ignoreNullFields": "false"}

# section -> measure that is summed when a document is checked
_MEASURES = {
    "kpis": "total_orders",
    "repeat_rate": "repeat_customers",
    "monthly_trend": "orders",
    "category_performance": "units_sold",
    "cohort_matrix": "active_users",
    "rfm_segments": "customer_count",
    "market_basket": "co_orders",
    "channels": "orders",
}


def dashboard_sections(t: RetailTables) -> DataFrame:
    """The written document read back: rows per section and the sum of a measure."""
    path = scratch_path(t.products.sparkSession, "dashboard")
    write_dashboard(t, path)
    fields = []
    for name, measure in _MEASURES.items():
        row = f"struct<{measure}: bigint>"
        fields.append(f"{name}: {row if name in _RECORDS else f'array<{row}>'}")
    document = F.from_json("value", f"struct<{', '.join(fields)}>")

    def section(name, measure):
        rows = F.col("d").getField(name)
        if name in _RECORDS:
            rows = F.array(rows)
        total = F.aggregate(
            rows, F.lit(0).cast("bigint"), lambda acc, r: acc + r.getField(measure)
        )
        return F.struct(
            F.lit(name).alias("section"), F.size(rows).alias("n_rows"), total.alias("total")
        )

    sections = F.array(*[section(n, m) for n, m in _MEASURES.items()])
    text = t.products.sparkSession.read.text(path, wholetext=True)
    return text.select(document.alias("d")).select(F.inline(sections))


# Kinds of JSON values by the start of their type.
_KINDS = {"STRING": "text", "VOID": "missing"}


def dashboard_cells(t: RetailTables) -> DataFrame:
    """The written document read back as one row per value: section, row of the section
    (from 1), field, kind of value, and the value as number or text."""
    spark = t.products.sparkSession
    path = scratch_path(spark, "dashboard")
    write_dashboard(t, path)
    text = spark.read.text(path, wholetext=True)
    kind = "".join(f"WHEN '{start}' THEN '{name}' " for start, name in _KINDS.items())
    # A record section is an array of one row.
    return spark.sql(
        f"""
        SELECT s.key AS section, r.pos + 1 AS row_no, c.key AS field,
               CASE schema_of_variant(c.value) {kind} ELSE 'number' END AS kind,
               CASE WHEN schema_of_variant(c.value) <> 'STRING' THEN variant_get(c.value, '$', 'double') END AS number,
               CASE WHEN schema_of_variant(c.value) = 'STRING' THEN variant_get(c.value, '$', 'string') END AS text
        FROM (SELECT parse_json(value) AS document FROM {{read}}),
             LATERAL variant_explode(document) AS s,
             LATERAL variant_explode(CASE WHEN schema_of_variant(s.value) LIKE 'ARRAY%' THEN s.value
                                          ELSE parse_json(concat('[', to_json(s.value), ']')) END) AS r,
             LATERAL variant_explode(r.value) AS c""",
        read=text,
    )


def write_dashboard(t: RetailTables, path: str) -> None:
    sinks.write_document(dashboard_payload(t), path)


def write_test_results(t: RetailTables, path: str) -> None:
    sinks.write_csv(stats.test_results_table(t), path)


def _exports(t: RetailTables) -> dict[str, DataFrame]:
    return {
        "customers": t.customers,
        "products": t.products,
        "orders": sales.order_rollup(t),
        "order_items": t.order_items,
        "analytics_master": bi.analytics_master(t),
    }


def write_retail_csv(t: RetailTables, folder: str) -> None:
    """The four entities and the wide table as headed CSV."""
    for name, df in _exports(t).items():
        sinks.write_csv(df, f"{folder}/{name}.csv")


def write_retail_parquet(t: RetailTables, folder: str) -> None:
    """The same as parquet. Analyses that read these tables find the order amounts
    and the order sequence stored instead of deriving them from lines each time."""
    for name, df in _exports(t).items():
        sinks.write_parquet(df, f"{folder}/{name}")


def write_retail_tables(t: RetailTables, prefix: str, buckets: int) -> None:
    """The same as catalogue tables. Orders and lines are bucketed by order, the key
    they are joined on."""
    keys = {"orders": "order_id", "order_items": "order_id"}
    for name, df in _exports(t).items():
        sinks.write_table(df, prefix + name, keys.get(name), buckets)


def products_through_csv(t: RetailTables) -> DataFrame:
    """The product catalogue written as CSV and read back with its schema."""
    path = scratch_path(t.products.sparkSession, "products-csv")
    sinks.write_csv(t.products.select(*PRODUCTS.fieldNames()), path)
    return files.read_csv_table(t.products.sparkSession, path, "products")


def orders_through_parquet(t: RetailTables) -> DataFrame:
    """The order table written month by month and read back."""
    spark = t.orders.sparkSession
    path = scratch_path(spark, "orders-parquet")
    orders = sales.order_rollup(t)
    month = F.date_format("order_date_only", "yyyy-MM").alias("order_month")
    # rebalance: few files per month, yet a large month is split over tasks
    by_month = orders.select("*", month).hint("rebalance", F.col("order_month"))
    sinks.write_parquet(by_month, path, ["order_month"])
    return spark.read.parquet(path).select(*orders.columns)
