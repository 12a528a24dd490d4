"""What the training-data operators share: tables and checked joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.workers import ready

__all__ = ["BROADCAST_ROWS", "Scratch", "ID_ROWS", "fresh", "join_checked", "only", "small_batches", "table"]

#: A side is broadcast up to so many rows (of a few short columns), otherwise the planner joins by shuffle.
BROADCAST_ROWS = 50_000
#: And up to so many if a row is but one number.
ID_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session from now on sends Python workers batches of a few MB, whatever the rows' size."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = re.match(r"\d+", df.sparkSession.conf.get(key))
    if not now or not 0 < int(now[0]) <= most:
        df.sparkSession.conf.set(key, f"{most}b")
    return ready(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for none to be a column of the frame."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def only(docs: DataFrame, ids: DataFrame, rows: int = ID_ROWS) -> DataFrame:
    """The documents with these ids (column doc_id). Up to `rows` ids are broadcast, so that the other texts are
    never shuffled; beyond that the documents stay as they are and the join that follows drops the others."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.limit(rows + 1).count() <= rows else docs


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins, with the right side broadcast if it has at most `rows` rows; beyond that the planner's own
    shuffle join, whose hot keys adaptive execution splits."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)
