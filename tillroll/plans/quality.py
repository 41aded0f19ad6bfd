"""Declared constraints as checks that count violations.

All checks come from one pass over each table and one shuffle. Every row of a table
emits its primary key and its foreign keys, tagged with the table that owns the key;
keys are counted map-side by owner and child, so a key with very many rows moves once per
map task, and one row per key is left to judge. Missing values are tagged the same way, by
the name of their column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS
from tillroll.sources.tables import RetailTables

#: Owner of the rows that stand for a missing value.
_MISSING = "-"


def _required(df: DataFrame, table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table] if not f.nullable and f.name in df.columns]


def _tagged(df: DataFrame, table: str) -> DataFrame:
    """(owner, key, child): what a table's rows say about keys and missing values.

    ``child`` is null in the table that owns the key. A foreign key may be missing.
    """

    def tag(owner: str, key: Column, child: str | None) -> Column:
        child = F.lit(child).cast("string")
        return F.struct(F.lit(owner).alias("owner"), key.cast("string").alias("key"), child.alias("child"))

    tags = [tag(table, F.col(PRIMARY_KEYS[table]), None)]
    for child, key, parent in FOREIGN_KEYS:
        if child == table:
            tags.append(F.when(F.col(key).isNotNull(), tag(parent, F.col(key), child)))
    missing = [F.when(F.col(c).isNull(), tag(_MISSING, F.lit(f"{table}.{c}"), None)) for c in _required(df, table)]
    any_missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in _required(df, table)))
    # hardly ever taken, so a sound row emits its keys only
    found = F.when(any_missing, F.array(*tags, *missing)).otherwise(F.array(*tags))
    return df.select(F.inline(found)).where("owner is not null")


def dq_keys(t: RetailTables) -> DataFrame:
    """One row per check: duplicated keys, orphan rows, missing values."""
    tables = {name: getattr(t, name) for name in SCHEMAS}
    tagged = reduce(DataFrame.unionByName, (_tagged(df, name) for name, df in tables.items()))
    children = sorted({child for child, _, _ in FOREIGN_KEYS})
    per_key = tagged.groupBy("owner", "key").agg(
        F.count_if(F.col("child").isNull()).alias("owners"),
        *[F.count_if(F.col("child") == c).alias(f"of_{c}") for c in children],
    )
    checks: list[tuple[str, str, str, Column]] = []
    for name, key in PRIMARY_KEYS.items():
        repeated = (F.col("owner") == name) & (F.col("owners") > 1)
        checks.append(("primary_key", name, key, F.count_if(repeated)))
    for child, key, parent in FOREIGN_KEYS:
        orphan = (F.col("owner") == parent) & (F.col("owners") == 0)
        checks.append(("foreign_key", child, key, F.sum(F.when(orphan, F.col(f"of_{child}")))))
    for name, df in tables.items():
        for column in _required(df, name):
            is_it = (F.col("owner") == _MISSING) & (F.col("key") == f"{name}.{column}")
            checks.append(("not_null", name, column, F.max(F.when(is_it, F.col("owners")))))
    counted = per_key.agg(
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(f"n{i}") for i, (*_, n) in enumerate(checks)]
    )
    rows = [
        F.struct(
            F.lit(kind).alias("check_type"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.col(f"n{i}").alias("violations"),
        )
        for i, (kind, table, column, _) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))
