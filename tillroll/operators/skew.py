"""Finding hot keys and joining around them.

Hot keys only ever steer how work is spread; results do not depend on which keys are
reported. They live in a small written table with a slice count per key, never in the
text of a plan, so a hundred thousand of them cost what any small dimension costs.
"""

from __future__ import annotations

from functools import cached_property
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.operators.scratch import materialize

# Rows that a task takes where it holds them, or a group for nearly each, in memory.
HELD_ROWS = 500_000
# Keys of more rows than this are split. A table has at most rows / ROWS_PER_TASK of them.
ROWS_PER_TASK = 2_000_000
# The sketch follows SEEN times as many items as there can be such keys, between these
# bounds, and so sees them all up to about 500 billion rows.
SEEN = 4
MIN_ITEMS, MAX_ITEMS = 4_000, 1_000_000
# Range slices are bounded too: their borders are sampled on the driver.
MAX_SLICES = 5000
# Side tables of up to so many rows, each of a key and a few numbers, are broadcast.
BROADCAST_ROWS = 250_000

_ROWS = "bigint"


def slices_for(rows: int) -> int:
    """Range slices for ``rows`` rows, one where a task can take them all."""
    return max(1, min(MAX_SLICES, ceil(rows / ROWS_PER_TASK)))


class HotKeys:
    """Hot values of one key column with their (approximate) row counts.

    ``table`` has the columns key and rows. It is given as a written frame, or made from
    ``counts`` where the keys are few and known. ``of_rows`` is the number of all rows of the
    table that the keys are from, where that was counted.
    """

    def __init__(self, counts: dict | None = None, table: DataFrame | None = None, of_rows: int = 0):
        self._given, self.table, self.of_rows = counts or {}, table, of_rows

    def tasks(self) -> int:
        """Tasks for all rows where each holds its share in memory; 1 where one can."""
        return max(1, ceil(self.of_rows / HELD_ROWS))

    @cached_property
    def _size(self) -> tuple[int, int, int]:
        """Keys, their rows, and the rows of the largest."""
        if self.table is None:
            rows = self._given.values()
            return len(rows), sum(rows), max(rows, default=0)
        size = self.table.agg(F.count("*"), F.sum("rows"), F.max("rows")).first()
        return size[0], size[1] or 0, size[2] or 0

    def __bool__(self) -> bool:
        return self._size[0] > 0

    def __len__(self) -> int:
        return self._size[0]

    @cached_property
    def counts(self) -> dict:
        """For inspection: the keys and their rows on the driver."""
        if self.table is None:
            return self._given
        return {r["key"]: r["rows"] for r in self.table.collect()}

    def slices(self) -> int:
        return slices_for(self._size[1])

    def fanout(self) -> int:
        """Slices of the largest key."""
        return max(2, ceil(self._size[2] / ROWS_PER_TASK))

    def _rows(self, df: DataFrame, key: str) -> DataFrame:
        """The table with the type of ``df[key]``: key, and ``_fanout``, its slices."""
        kind = df.schema[key].dataType.simpleString()
        table = self.table
        if table is None:
            table = df.sparkSession.createDataFrame(list(self._given.items()), f"key {kind}, rows {_ROWS}")
        fanout = F.greatest(F.lit(2), F.ceil(F.col("rows") / ROWS_PER_TASK)).cast("int")
        return table.select(F.col("key").cast(kind).alias(key), fanout.alias("_fanout"))

    def marked(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``_fanout``: the slices of the row's key, null for ordinary keys.

        Up to ``BROADCAST_ROWS`` hot keys are broadcast. More of them are joined by a
        shuffle in which a hot key's rows are dealt over as many parts as the largest key
        needs, and the table is repeated once per part.
        """
        return attach(df, self._rows(df, key), key, len(self), self.fanout())


def attach(df: DataFrame, side: DataFrame, key: str, side_rows: int, parts: int) -> DataFrame:
    """Left join to ``side``, a table of ``side_rows`` rows with one row per ``key``,
    whatever the number of rows of a key in ``df``."""
    added = [c for c in side.columns if c != key]
    if side_rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), key, "left").select(*df.columns, *added)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    repeated = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(repeated, [key, "_part"], "left").select(*df.columns, *added)


def exact_hot(counts: DataFrame, key: str, rows: str) -> HotKeys:
    """Hot keys of a table of exact counts per key."""
    hot = counts.where(F.col(rows) > ROWS_PER_TASK)
    return HotKeys(table=materialize(hot.select(F.col(key).alias("key"), F.col(rows).cast(_ROWS).alias("rows")), "hot"))


def hot_keys(df: DataFrame, *keys: str) -> list[HotKeys]:
    """Heavy hitters of each key column, from one scan of just those columns.

    The rows are counted first (from the footers where the table is stored). The
    frequent-items sketch then has room for every key that can be hot among them; it is
    merged map-side, so its cost is one narrow scan, and its items are written without
    passing through the driver. Keys of up to ``ROWS_PER_TASK`` rows fit in a task and
    are not reported.
    """
    rows = df.count()
    if rows <= ROWS_PER_TASK:
        return [HotKeys(of_rows=rows) for _ in keys]
    most = ceil(rows / ROWS_PER_TASK)
    items = min(MAX_ITEMS, max(MIN_ITEMS, SEEN * most))
    sketches = materialize(
        df.agg(
            *[
                F.call_function(
                    "approx_top_k", F.col(k), F.lit(min(items, max(most, 1_000))), F.lit(items)
                ).alias(f"_{at}")
                for at, k in enumerate(keys)
            ]
        ),
        "sketch",
    )
    found = []
    for at, _ in enumerate(keys):
        seen = sketches.select(F.inline(f"_{at}"))
        hot = seen.where(F.col("item").isNotNull() & (F.col("count") > ROWS_PER_TASK))
        table = hot.select(F.col("item").alias("key"), F.col("count").cast(_ROWS).alias("rows"))
        found.append(HotKeys(table=materialize(table, "hot"), of_rows=rows))
    return found


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    hot: HotKeys,
    spread_by: list[str],
    how: str = "inner",
    tasks: int = 1,
) -> DataFrame:
    """Join many ``rows`` to a side with few rows per ``key``.

    Without hot keys this is the plain equi-join and Catalyst picks the strategy
    from the sizes. The rows of a hot key are spread over the key's own number of salts
    by a hash of ``spread_by``; the rows of the other side are repeated once per salt.
    ``tasks`` above 1 has a shuffle deal both sides over so many tasks at least, whatever
    number the session sets, for a later grouping by the key that holds the rows in memory.
    """

    def dealt(side: DataFrame, *by: str) -> DataFrame:
        """The smaller side, dealt; the larger one follows, and is still moved just once."""
        if tasks <= 1:
            return side
        return side.repartition(max(tasks, int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)

    if not hot:
        return rows.join(dealt(per_key, key), key, how)
    fanout = F.col("_fanout")
    salt = F.pmod(F.xxhash64(*spread_by), fanout.cast("bigint")).cast("int")
    salted_rows = hot.marked(rows, key).withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_fanout")
    salts = F.sequence(F.lit(0), F.coalesce(fanout, F.lit(1)) - 1)
    salted_keys = hot.marked(per_key, key).withColumn("_salt", F.explode(salts)).drop("_fanout")
    return salted_rows.join(dealt(salted_keys, key, "_salt"), [key, "_salt"], how).drop("_salt")


def grid_join(
    left: DataFrame, right: DataFrame, key: str, left_spread: list[str], right_spread: list[str]
) -> DataFrame:
    """Inner join of two sides that may both have very many rows of a key.

    The output of a key is a rectangle, cut into cells of up to ``ROWS_PER_TASK`` rows: the
    left rows are dealt over the rectangle's rows of cells, the right ones over its
    columns, and each side is repeated along the other. Both sides are read twice, so
    they should be stored.
    """
    edge = max(1, isqrt(ROWS_PER_TASK))
    n = [side.groupBy(key).agg(F.count("*").alias(f"_n{at}")) for at, side in enumerate((left, right))]
    cells = [F.ceil(F.col(f"_n{at}") / edge).cast("int").alias(f"_c{at}") for at in (0, 1)]
    large = n[0].join(n[1], key).where(F.col("_n0") * F.col("_n1") > ROWS_PER_TASK).select(key, *cells)
    large = materialize(large, "grid")
    size = large.agg(F.count("*"), F.max("_c0"), F.max("_c1")).first()
    if not size[0]:
        return left.join(right, key)

    def dealt(side, at, spread):
        found = attach(side, large, key, size[0], size[1 + at])
        mine, other = F.col(f"_c{at}").cast("bigint"), F.col(f"_c{1 - at}")
        place = F.coalesce(F.pmod(F.xxhash64(*spread), mine).cast("int"), F.lit(0))
        along = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        found = found.withColumn(f"_p{at}", place).withColumn(f"_p{1 - at}", F.explode(along))
        return found.drop("_c0", "_c1")

    on = [key, "_p0", "_p1"]
    return dealt(left, 0, left_spread).join(dealt(right, 1, right_spread), on).drop("_p0", "_p1")


def with_group_values(
    df: DataFrame, key: str, hot: HotKeys, values: dict[str, Column]
) -> DataFrame:
    """Attach aggregates of each row's ``key`` group to the row.

    Ordinary groups fit in a window, which moves the rows once. A hot group is
    aggregated map-side to a single row and attached to its rows where they are.
    """
    over = W.partitionBy(key)
    windowed = lambda rows: rows.withColumns({n: v.over(over) for n, v in values.items()})
    if not hot:
        return windowed(df)
    rows = hot.marked(df, key)
    hot_rows = rows.where(F.col("_fanout").isNotNull()).drop("_fanout")
    per_key = hot_rows.groupBy(key).agg(*[v.alias(n) for n, v in values.items()])
    attached = attach(hot_rows, per_key, key, len(hot), hot.fanout())
    return windowed(rows.where(F.col("_fanout").isNull()).drop("_fanout")).unionByName(attached)
