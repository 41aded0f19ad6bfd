"""Python workers find this package where the driver found it."""

from __future__ import annotations

import os

import tillroll
from pyspark.sql import SparkSession


def find_package(spark: SparkSession) -> None:
    """Put the folder of the package on the workers' path, for drivers that only put it on
    their own. Where executors have the package installed this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(tillroll.__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
