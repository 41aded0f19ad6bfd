"""The position of every row in its group's order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.operators.scratch import materialize

#: ``monotonically_increasing_id`` has the partition above so many bits of row number.
_ROW_BITS = 33


def positions(df: DataFrame, group: list[str], order: list[Column], label: str = "ordered") -> DataFrame:
    """Add ``pos`` (0-based place of the row in ``order`` within its ``group``) and
    ``size`` (rows of the group), both bigint. No group columns: the table is one group.

    The rows are range-partitioned by (group, order) and written once with their row
    numbers, so a group is cut into as many slices as it fills and no window takes more
    than the slices of a group. Rows before a slice come from one count per slice and
    group. ``order`` must part the rows of a group, or rows that it leaves equal may
    take their places in any order. Group columns must not be null.
    """
    by = [F.col(c) for c in group] + order
    ranged = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    counted = ranged.groupBy(*group, part).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per group and slice. Written, so that the join below knows its size.
    starts = materialize(
        counted.select(
            *group,
            "_part",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(whole).alias("size"),
        ),
        f"{label}-starts",
    )
    return (
        ranged.withColumn("_part", part)
        .join(starts, [*group, "_part"])
        .select(*df.columns, (F.col("_id") + F.col("_shift")).alias("pos"), "size")
    )
