"""What a session needs to run this package's functions on its workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started.

    Workers elsewhere get it with ``--py-files`` or an installed package.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, so that a batch of long texts stays small; never raises a lower bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
