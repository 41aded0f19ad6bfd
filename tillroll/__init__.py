"""Retail customer analytics on Spark DataFrames."""

from tillroll.sources.tables import RetailTables
from tillroll.sources.files import (
    load_catalog_tables,
    load_csv_tables,
    load_parquet_tables,
)
from tillroll.sources.tpch import load_tpch_tables

__all__ = [
    "RetailTables",
    "load_catalog_tables",
    "load_csv_tables",
    "load_parquet_tables",
    "load_tpch_tables",
]
