"""Writers. All replace what is there, as a batch export does."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 1
) -> None:
    """A catalogue table, bucketed where later joins or groupings share a key: they
    then read it in place instead of shuffling it."""
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON text per row of a one-column frame."""
    df.write.mode("overwrite").text(path)
