"""Progress and cancelling of long jobs, and a running total over scans that arrive in parts."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Seconds between two reports.
INTERVAL = 0.1


class Throttle:
    """Lets a report through at most every INTERVAL seconds; the last one always."""

    def __init__(self, report, interval: float = INTERVAL, clock=time.monotonic):
        self.report, self.interval, self.clock, self.last = report, interval, clock, None

    def __call__(self, *args, final: bool = False) -> None:
        now = self.clock()
        if final or self.last is None or now - self.last >= self.interval:
            self.last = now
            self.report(*args)


def observed(nodes: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The frame, and an observation with files, folders and bytes once an action has run over it."""
    seen = Observation(name)
    return nodes.observe(
        seen, F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("folders"), F.sum(F.when(~F.col("is_directory"), F.col("size_bytes"))).alias("bytes")
    ), seen


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started within can be stopped from another thread by spark.interruptTag(tag)."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def running_totals(leaves: DataFrame) -> DataFrame:
    """Files and bytes by scan of a stream of leaves (scan_id, size_bytes); for complete or update mode."""
    return leaves.groupBy("scan_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))
