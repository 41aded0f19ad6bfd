"""Every analysis as a query over a folder of TPC-H-shaped parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.functions.exact import decimals_to_double
from tillroll.plans import active, basket, bi, cohort, export, lifecycle, quality, rfm, sales, stats
from tillroll.sources.calendar import calendar
from tillroll.sources.tables import RetailTables
from tillroll.sources.tpch import TpchTables, load_tpch_tables

Query = Callable[[SparkSession, str], DataFrame]


def _brand_baskets(t: TpchTables) -> basket.BasketInput:
    """Baskets of brands: parts are so many that few pairs of them ever repeat."""
    brand = F.col("brand")
    return basket.BasketInput(
        t.brand_lines().select("order_id", brand.alias("product_id")),
        t.completed_keys(),
        None,
        t.brands().select(
            brand.alias("product_id"),
            brand.alias("product_name"),
            F.lit("Brand").alias("category"),
        ),
    )


def _rated_orders(t: RetailTables) -> DataFrame:
    """Order amounts from the lines with a discount rate per order: 0, 5, 10 or 15 %."""
    headers = t.orders.select(
        "order_id",
        "customer_id",
        (F.col("order_id") % 4 * F.lit(5) / F.lit(100)).alias("rate"),
        "shipping_fee",
    )
    return sales.roll_up_lines(headers, t.order_items, "rate", "shipping_fee").select(
        "order_id", "subtotal", "discount_amount", "total_amount", "total_cost", "gross_profit"
    )


def _sample_rows(t: RetailTables) -> DataFrame:
    return lifecycle.running_spend(t, limit=25)


_ANALYSES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "customer_order_summary": sales.customer_order_summary,
    "monthly_sales_summary": sales.monthly_sales_summary,
    "cohort_retention": cohort.cohort_retention,
    "cohort_retention_pivot": cohort.cohort_retention_pivot,
    "cohort_matrix_dashboard": cohort.cohort_matrix_dashboard,
    "rfm_scores": rfm.rfm_scores,
    "rfm_segment_summary": rfm.rfm_segment_summary,
    "rfm_dashboard": rfm.rfm_dashboard,
    "rfm_five_segments": rfm.rfm_five_segments,
    "running_spend": lifecycle.running_spend,
    "running_spend_first_rows": _sample_rows,
    "repurchase_funnel": lifecycle.repurchase_funnel,
    "interpurchase_by_transition": lifecycle.interpurchase_by_transition,
    "market_basket_pairs": lambda t: basket.market_basket_pairs(t, min_pair_orders=2),
    "market_basket_brand_pairs": lambda t: basket.market_basket_pairs(
        t, source=_brand_baskets(t)
    ),
    "top_pairs_dashboard": basket.top_pairs_dashboard,
    "executive_kpis": sales.executive_kpis,
    "repeat_customer_rate": lifecycle.repeat_customer_rate,
    "monthly_trend": sales.monthly_trend,
    "category_performance": sales.category_performance,
    "channel_distribution": sales.channel_distribution,
    "h1_discount_effect": stats.h1_discount_effect,
    "h2_channel_contingency": stats.h2_channel_contingency,
    "h2_chi_square": stats.h2_chi_square,
    "h3_first_basket_ltv": stats.h3_first_basket_ltv,
    "h3_by_customer_group": stats.h3_by_customer_group,
    "hypothesis_p_values": stats.hypothesis_p_values,
    "hypothesis_log10_p": stats.hypothesis_log10_p,
    "test_results_table": lambda t: stats.test_results_table(t, digits=8),
    "analytics_master": bi.analytics_master,
    "order_rollup": sales.order_rollup,
    "order_rollup_by_rate": _rated_orders,
    "product_margin": sales.product_margin,
    "category_count": sales.category_count,
    "bi_core_measures": bi.bi_core_measures,
    "bi_core_measures_by_region": lambda t: bi.bi_core_measures(t, ["region", "order_status"]),
    "bi_prior_year_daily": bi.bi_prior_year_daily,
    "bi_yoy_growth": bi.bi_yoy_growth,
    "bi_rolling_30d": bi.rolling_sales,
    "bi_yoy_growth_by_region": lambda t: bi.bi_yoy_growth(t, ["region"]),
    "bi_rolling_30d_by_status": lambda t: bi.rolling_sales(t, by=["region", "order_status"]),
    "bi_cohort_measures": bi.bi_cohort_measures,
    "bi_repeat_rate": bi.bi_repeat_rate,
    "bi_repeat_rate_by_slice": lambda t: bi.bi_repeat_rate(t, ["acquisition_channel", "order_status"]),
    "lod_customer_fields": bi.lod_customer_fields,
    "rfm_threshold_segments": rfm.threshold_segments,
    "dashboard_payload": export.dashboard_payload,
    "dashboard_cells": export.dashboard_cells,
    "dashboard_sections": export.dashboard_sections,
    "active_customers_rollup": active.active_customers_rollup,
    "conditional_survival": lifecycle.conditional_survival,
    "repurchase_median": lifecycle.repurchase_median,
    "avg_month1_retention": cohort.avg_month1_retention,
    "avg_month1_retention_all": cohort.avg_month1_retention_all,
    "dq_keys": quality.dq_keys,
    "date_dimension": lambda t: calendar(t.orders, "order_date_only"),
    "products_through_csv": export.products_through_csv,
    "orders_through_parquet": export.orders_through_parquet,
}


def _query(analysis: Callable[[RetailTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decimals_to_double(analysis(load_tpch_tables(spark, sf_dir)))

    return run


def queries() -> dict[str, Query]:
    return {name: _query(analysis) for name, analysis in _ANALYSES.items()}
