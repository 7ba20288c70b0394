"""Python workers must import this package from where the driver has it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_importable(spark: SparkSession) -> None:
    """Add the package's home to the workers' path, for sessions that were started elsewhere."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, HOME])
