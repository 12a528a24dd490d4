"""What Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def can_import(spark: SparkSession) -> None:
    """Workers that start from now on look for this package where the driver found it, after their own paths."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def ready(df: DataFrame) -> DataFrame:
    """The frame, for a function that runs in Python workers."""
    can_import(df.sparkSession)
    return df
