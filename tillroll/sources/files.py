"""Retail tables from files or catalogue tables in their own schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.sources.schemas import DEFAULT_ZERO, SCHEMAS
from tillroll.sources.tables import RetailTables


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("decimal(18,2)")) for c in DEFAULT_ZERO.get(table, [])}
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check that ``df`` has the declared columns and cast them to their types.

    Ids keep the type they are stored with, and with it any bucketing on them.
    """
    schema = SCHEMAS[table]
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    typed = df.select(
        *[
            F.col(f.name) if f.name.endswith("_id") else F.col(f.name).cast(f.dataType)
            for f in schema
        ]
    )
    return with_defaults(typed, table)


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A headed CSV file or folder with the declared schema; never inferred. A row that
    does not parse is an error, not a row of NULLs."""
    df = (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return with_defaults(df, table)


def load_csv_tables(spark: SparkSession, folder: str) -> RetailTables:
    return RetailTables(
        **{t: read_csv_table(spark, f"{folder}/{t}.csv", t) for t in SCHEMAS}
    )


def load_parquet_tables(spark: SparkSession, folder: str) -> RetailTables:
    return RetailTables(
        **{t: conform(spark.read.parquet(f"{folder}/{t}"), t) for t in SCHEMAS}
    )


def load_catalog_tables(spark: SparkSession, prefix: str = "") -> RetailTables:
    """From catalogue tables ``<prefix>customers`` and so on."""
    return RetailTables(**{t: conform(spark.table(prefix + t), t) for t in SCHEMAS})
