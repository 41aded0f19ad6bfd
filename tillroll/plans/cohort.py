"""Monthly acquisition cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillroll.functions.dates import month_label
from tillroll.functions.exact import mean, pct
from tillroll.sources.schemas import COMPLETED
from tillroll.sources.tables import RetailTables


def _cohort_activity(t: RetailTables, status: str) -> DataFrame:
    """Active customers per (cohort month, months since).

    A customer's orders shrink to a bit mask of its active months: hash aggregates on both
    sides of the only shuffle of customers. The least month is the cohort, so orders need
    not be joined to their own first purchase.
    """
    offset = (F.col("month_no") - F.col("cohort_no")).alias("offset")
    months = t.month_mask.spread(t.customer_months(status))
    return months.groupBy("cohort_no", offset).agg(F.count("*").alias("active"))


def _with_size(activity: DataFrame) -> DataFrame:
    """A cohort's size is its activity at offset 0; one row per cohort and month."""
    size = F.max(F.when(F.col("offset") == 0, F.col("active")))
    return activity.withColumn("size", size.over(W.partitionBy("cohort_no")))


def cohort_retention(
    t: RetailTables,
    status: str = COMPLETED,
    max_offset: int | None = None,
    dp: int = 2,
) -> DataFrame:
    rows = _with_size(_cohort_activity(t, status))
    if max_offset is not None:
        rows = rows.where(F.col("offset") <= max_offset)
    return rows.select(
        month_label(F.col("cohort_no")).alias("cohort_month"),
        F.col("size").alias("initial_customers"),
        F.col("offset").alias("month_offset"),
        F.col("active").alias("active_customers"),
        pct(F.col("active"), F.col("size"), dp).alias("retention_rate_pct"),
    ).orderBy("cohort_month", "month_offset")


def cohort_matrix_dashboard(t: RetailTables) -> DataFrame:
    return cohort_retention(t, max_offset=12, dp=1).select(
        "cohort_month",
        F.col("initial_customers").alias("cohort_size"),
        F.col("month_offset").alias("cohort_index"),
        F.col("active_customers").alias("active_users"),
        F.col("retention_rate_pct").alias("retention_pct"),
    )


def cohort_retention_pivot(
    t: RetailTables, status: str = COMPLETED, months: int = 7, dp: int = 1
) -> DataFrame:
    """One row per cohort; a month without activity is 0.0, seen or not."""
    counts = (
        _cohort_activity(t, status)
        .groupBy("cohort_no")
        .pivot("offset", list(range(months)))
        .agg(F.sum("active"))
        .na.fill(0)
    )
    return counts.select(
        month_label(F.col("cohort_no")).alias("cohort_month"),
        F.col("0").alias("cohort_size"),
        *[
            pct(F.col(str(k)), F.col("0"), dp).alias(f"m{k}_retention_pct")
            for k in range(months)
        ],
    ).orderBy("cohort_month")


def avg_month1_retention(t: RetailTables) -> DataFrame:
    """Month-1 retention over the cohorts that show it: mean of rates and pooled. Cohorts
    without a month 1 are left out, see ``avg_month1_retention_all``."""
    month1 = cohort_retention(t).where(F.col("month_offset") == 1)
    rate = F.col("retention_rate_pct").cast("decimal(10,2)")
    return month1.agg(
        F.count("*").alias("cohorts"),
        mean(F.sum(rate), F.count("*"), 2).alias("avg_retention_pct"),
        pct(F.sum("active_customers"), F.sum("initial_customers"), 2).alias(
            "pooled_retention_pct"
        ),
    )


def avg_month1_retention_all(t: RetailTables, status: str = COMPLETED) -> DataFrame:
    """The same over every cohort old enough to have a month 1: one that nobody came back
    in counts as 0. Old enough are the cohorts before the last month with an order."""
    activity = _cohort_activity(t, status)
    at = lambda k: F.coalesce(F.sum(F.when(F.col("offset") == k, F.col("active"))), F.lit(0))
    last = F.max(F.col("cohort_no") + F.col("offset"))
    cohorts = activity.groupBy("cohort_no").agg(at(0).alias("size"), at(1).alias("back"), last.alias("until"))
    # one row per cohort
    old = cohorts.withColumn("last", F.max("until").over(W.partitionBy())).where("cohort_no < last")
    rate = pct(F.col("back"), F.col("size"), 2).cast("decimal(10,2)")
    return old.agg(
        F.count("*").alias("cohorts"),
        mean(F.sum(rate), F.count("*"), 2).alias("avg_retention_pct"),
        pct(F.sum("back"), F.sum("size"), 2).alias("pooled_retention_pct"),
    )
