"""Running values per key in a given row order, safe for a key of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.operators.scratch import materialize
from tillroll.operators import skew
from tillroll.operators.skew import HotKeys


def ordered_scan(
    df: DataFrame,
    key: str,
    order: list[str],
    hot: HotKeys,
    *,
    count: str | None = None,
    sums: dict[str, Column] | None = None,
    prev_max: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over ``partition by key order by order``.

    ``count``     1-based position of the row
    ``sums``      running sum including the row
    ``prev_max``  maximum over the rows before it (NULL for the first)

    Ordinary keys take one window shuffle. A hot key would put all its rows into one
    window task, so its rows are range-partitioned by (key, order) instead: each
    slice runs the same windows on its own, and the totals of the earlier slices
    are added. ``order`` must be unique within a key.
    """
    spec = dict(count=count, sums=sums or {}, prev_max=prev_max or {})
    if not hot:
        return _running(df, [key], order, **spec)
    marked, is_hot = hot.marked(df, key), F.col("_fanout").isNotNull()
    ordinary = _running(marked.where(~is_hot).drop("_fanout"), [key], order, **spec)
    sliced = _sliced(marked.where(is_hot).drop("_fanout"), key, order, hot, **spec)
    return ordinary.unionByName(sliced)


def _running(df, by, order, count, sums, prev_max):
    ordered = W.partitionBy(*by).orderBy(*order)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    added = {}
    if count:
        added[count] = F.row_number().over(ordered)
    for name, value in sums.items():
        added[name] = F.sum(value).over(upto)
    for name, value in prev_max.items():
        added[name] = F.max(value).over(before)
    return df.withColumns(added)


def _sliced(df, key, order, hot, count, sums, prev_max):
    slices = hot.slices()
    # Written once: the slice numbers must be the same for the running values and
    # for the totals carried between slices, whatever happens to an executor.
    ranged = materialize(
        df.repartitionByRange(slices, key, *order).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    local = _running(ranged, [key, "_slice"], order, count, sums, prev_max)

    totals = [F.count("*").alias("_rows")]
    totals += [F.sum(v).alias(f"_t_{n}") for n, v in sums.items()]
    totals += [F.max(v).alias(f"_t_{n}") for n, v in prev_max.items()]
    earlier = (
        W.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carried = [F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_c_rows")]
    carried += [F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums]
    carried += [F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in prev_max]
    # A slice boundary splits one key, so this has at most slices + hot keys rows.
    carry = (
        ranged.groupBy(key, "_slice").agg(*totals).select(key, "_slice", *carried)
    )

    final = {}
    if count:
        final[count] = (F.col(count) + F.col("_c_rows")).cast("int")
    for name in sums:
        # a running sum is NULL until the first non-null value, on both levels
        final[name] = F.coalesce(
            F.col(name) + F.col(f"_c_{name}"), F.col(name), F.col(f"_c_{name}")
        ).cast(local.schema[name].dataType)
    for name in prev_max:
        final[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
    if slices + len(hot) <= skew.BROADCAST_ROWS:
        carry = F.broadcast(carry)
    out = local.join(carry, [key, "_slice"]).withColumns(final)
    return out.select(*[c for c in local.columns if c != "_slice"])
