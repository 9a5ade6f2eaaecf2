"""What a session needs before this package's functions run in Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did.

    Workers started by other machines need it there too (a shared path or --py-files).
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])
    return spark
