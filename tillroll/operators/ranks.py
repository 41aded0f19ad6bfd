"""Sufficient statistics of two-sample tests, reduced on executors to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BIG = "decimal(38,0)"
_MONEY = "decimal(18,2)"


def _sums_of(value: Column, n: Column) -> tuple[Column, Column]:
    """Sum and sum of squares of ``n`` copies of each value."""
    x = value.cast(_MONEY)
    return F.sum(x * n), F.sum(x * x * n)


def power_sums(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """One row of exact sums per sample: ``n1, s1, q1, n2, s2, q2``."""
    out = []
    for i, chosen in ((1, in_first), (2, ~in_first)):
        one = F.when(chosen, F.lit(1).cast("decimal(1,0)"))
        total, squares = _sums_of(F.col(value), one)
        out += [
            F.count(one).alias(f"n{i}"),
            total.alias(f"s{i}"),
            squares.alias(f"q{i}"),
        ]
    return df.where(F.col(value).isNotNull()).agg(*out)


def rank_sums(
    df: DataFrame,
    value: str,
    in_first: Column,
    extra: dict[str, Column] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """The power sums plus ``u1, tie_term`` for the Mann-Whitney test, and the sums
    of ``extra`` columns, all from one pass over ``df``; one row, or one per ``by`` group.

    ``u1`` counts the pairs in which the first sample is larger, ties as half;
    ``tie_term`` is the sum of t^3 - t over groups of t tied values.

    Equal values are counted first, so ties of any size become one row. The distinct
    values are then range-partitioned: within a slice a window counts the second
    sample below each value, and slices are combined from one summary row each.
    Slice numbers live within a single job, so they cannot disagree with themselves.
    """
    extra = extra or {}
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(
            F.count(F.when(in_first, 1)).cast(_BIG).alias("n1"),
            F.count(F.when(~in_first, 1)).cast(_BIG).alias("n2"),
            *[F.sum(c).alias(name) for name, c in extra.items()],
        )
    )
    below = (
        W.partitionBy(*by, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    tied = (F.col("n1") + F.col("n2")).cast("double")
    s1, q1 = _sums_of(F.col(value), F.col("n1"))
    s2, q2 = _sums_of(F.col(value), F.col("n2"))
    twice_local_u = F.col("n1") * (F.col("_below") * 2 + F.col("n2"))
    slices = (
        counted.repartitionByRange(*by, value)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_below", F.coalesce(F.sum("n2").over(below), F.lit(0)).cast(_BIG))
        .groupBy(*by, "_slice")
        .agg(
            F.sum("n1").cast(_BIG).alias("n1"),
            F.sum("n2").cast(_BIG).alias("n2"),
            F.sum(twice_local_u.cast(_BIG)).cast(_BIG).alias("_twice_u"),
            F.sum(tied * tied * tied - tied).alias("_ties"),
            s1.alias("s1"),
            q1.alias("q1"),
            s2.alias("s2"),
            q2.alias("q2"),
            *[F.sum(name).alias(name) for name in extra],
        )
    )
    # one row per shuffle partition (and group) from here on
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    n2_before = F.coalesce(F.sum("n2").over(earlier), F.lit(0)).cast(_BIG)
    twice_u = F.col("_twice_u") + F.col("n1") * F.col("_n2_before") * 2
    kept = ["s1", "q1", "s2", "q2", *extra]
    return slices.withColumn("_n2_before", n2_before).groupBy(*by).agg(
        F.sum("n1").cast("bigint").alias("n1"),
        F.sum("n2").cast("bigint").alias("n2"),
        (F.sum(twice_u.cast(_BIG)).cast("double") / 2).alias("u1"),
        F.sum("_ties").alias("tie_term"),
        *[F.sum(name).alias(name) for name in kept],
    )
