"""Letting Python workers import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Puts the folder that holds the package on the workers' path, unless PYTHONPATH has it.

    Enough where executors see that folder; elsewhere pass the package with --py-files.
    """
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
