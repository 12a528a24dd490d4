"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from urllib.parse import urlparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session without one gets a folder beside its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def local_shared_dir(spark: SparkSession) -> str:
    """The shared folder as a path that tasks can open; ValueError if it is not in a mounted file system."""
    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        raise ValueError(f"files can be made in a mounted file system only, not in {found.scheme}:")
    return found.path


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Scratch:
    """Tables written to the shared folder. They outlive lost executors and cut the lineage.

    `keep` writes a frame and returns it as read back; `hold` only caches one, for a few uses between two
    written tables, from which a lost part is computed again; `drop` deletes or uncaches them and lets
    the driver forget the shuffle files behind them. What is left goes when the process ends.
    """

    #: Seconds between two collections of garbage, and when the last one was.
    INTERVAL, last = 10.0, 0.0

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/arborlake/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def hold(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if hasattr(frame, "_scratch_path"):
                self._delete(frame._scratch_path)
            else:
                frame.unpersist()
        if time.monotonic() - Scratch.last > self.INTERVAL:
            gc.collect()
            self.spark._jvm.System.gc()  # Spark removes shuffle files once their frames are garbage
            Scratch.last = time.monotonic()

    def _delete(self, path: str) -> None:
        if path in self.paths:
            self.paths.remove(path)
            delete_folder(self.spark, path)

    def _at_exit(self) -> None:
        for path in list(self.paths):
            try:
                self._delete(path)
            except Exception:  # the JVM may be gone already
                return
