"""NTILE over a whole table without moving the table into one task.

``NTILE(t)`` only needs the t - 1 rows at which a tile ends. They are found by
sorting narrow (value, id) rows by range; scoring is then a comparison with at most
t - 1 literals per column: no shuffle of the wide rows, no join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.operators import skew
from tillroll.operators.scratch import materialize

_VALUE = "decimal(38,2)"


def tile_ends(n: int, tiles: int) -> list[int]:
    """1-based rank of the last row of every tile but the last."""
    size, longer = divmod(n, tiles)
    return [k * size + min(k, longer) for k in range(1, tiles)]


def add_ntiles(
    df: DataFrame,
    n: int,
    id_col: str,
    scores: dict[str, Column],
    tiles: int,
) -> DataFrame:
    """Add one tile number per entry of ``scores``: ``NTILE(tiles) OVER (ORDER BY
    value, id_col)``. ``df`` must be written or otherwise stable, with ``n`` rows and
    a unique ``id_col``; values are numeric with at most two decimals.
    """
    wanted = {e for e in tile_ends(n, tiles) if e > 0}
    narrow = df.select(
        F.col(id_col).alias("_id"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_score"), value.cast(_VALUE).alias("_value")
                    )
                    for name, value in scores.items()
                ]
            )
        ),
    )
    cuts = _rows_at_ranks(narrow, wanted, skew.slices_for(n * len(scores)))
    return df.withColumns(
        {
            name: sum(
                (
                    F.when(
                        (value.cast(_VALUE) > F.lit(v).cast(_VALUE))
                        | (
                            (value.cast(_VALUE) == F.lit(v).cast(_VALUE))
                            & (F.col(id_col) > F.lit(i))
                        ),
                        1,
                    ).otherwise(0)
                    for v, i in cuts.get(name, [])
                ),
                F.lit(1),
            ).cast("int")
            for name, value in scores.items()
        }
    )


def _rows_at_ranks(narrow: DataFrame, ranks: set[int], slices: int) -> dict:
    """``{score: [(value, id) at each rank]}``: at most len(scores) * tiles rows."""
    if not ranks:
        return {}
    if slices == 1:
        sliced = narrow.withColumn("_slice", F.lit(0))
        starts = None
    else:
        sliced = materialize(
            narrow.repartitionByRange(slices, "_score", "_value", "_id").withColumn(
                "_slice", F.spark_partition_id()
            ),
            "tiles",
        )
        # one row per slice (and score boundary), a count each
        starts = sliced.groupBy("_score", "_slice").count().orderBy("_score", "_slice")
        starts = starts.collect()

    local = F.row_number().over(
        W.partitionBy("_score", "_slice").orderBy("_value", "_id")
    )
    if starts is None:
        hit = F.col("_rank").isin(sorted(ranks))
        found = sliced.withColumn("_rank", local).where(hit)
    else:
        hits, before = [], {}
        for s in starts:
            done = before.get(s["_score"], 0)
            inside = [r - done for r in ranks if done < r <= done + s["count"]]
            hits += [(s["_score"], s["_slice"], r) for r in inside]
            before[s["_score"]] = done + s["count"]
        here = lambda score, part: (F.col("_score") == score) & (F.col("_slice") == part)
        any_of = lambda conds: F.coalesce(*[F.when(c, True) for c in conds], F.lit(False))
        found = (
            sliced.where(any_of([here(s, p) for s, p, _ in hits]))
            .withColumn("_rank", local)
            .where(any_of([here(s, p) & (F.col("_rank") == r) for s, p, r in hits]))
        )
    cuts: dict = {}
    for row in found.select("_score", "_value", "_id").collect():
        cuts.setdefault(row["_score"], []).append((row["_value"], row["_id"]))
    return cuts
