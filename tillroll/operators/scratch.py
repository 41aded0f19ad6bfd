"""Written intermediate tables.

A plan whose later steps must see exactly the rows of an earlier step (range
slices, ranks) is cut by writing the step as parquet into the shared folder named
by ``spark.checkpoint.dir``. A lost executor then costs a re-read, never a
recomputation that could slice the rows differently.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tillroll-")


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        return _local_root()  # driver and executor are one process
    raise RuntimeError(f"{_SETTING} must name a folder that every executor can reach")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's scratch folder."""
    app = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/tillroll-{app}"
    _make_folder(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _make_folder(folder: str) -> None:
    """Make the folder and have it removed when the application ends."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
