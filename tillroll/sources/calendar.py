"""Date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def calendar(df: DataFrame, day: str) -> DataFrame:
    """One row per day from the first to the last ``day`` in ``df``."""
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )
