"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Puts the folder of this package on the workers' path, where they share it with the driver.

    Elsewhere submit the package with ``--py-files``.
    """
    held = spark.sparkContext.environment
    paths = held.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        held["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
