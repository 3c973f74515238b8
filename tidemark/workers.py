"""Python workers must find this package, wherever the session was started."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Put the folder of this package on the Python path of workers started from now on. On a cluster whose
    machines lack that folder, install the package or pass it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark
