"""Numbering of rows in an order, over all rows or within keys, without a task that grows with one key."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Keys of up to so many rows are numbered by a window, each in one task.
HOT_ROWS = 500_000


def number_rows(df: DataFrame, order: Column | str, name: str = "nth") -> DataFrame:
    """Adds 1, 2, 3, ... by the order. Rows are dealt by range, numbered within each part, and shifted by
    the sizes of the parts before, of which there is one figure a part."""
    scratch = Scratch(df.sparkSession)
    dealt = scratch.keep(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(W.orderBy("__part")) - F.col("n")).drop("n")
    nth = F.row_number().over(W.partitionBy("__part").orderBy(order)) + F.col("__before")
    return dealt.join(F.broadcast(before), "__part").withColumn(name, nth.cast("bigint")).drop("__part", "__before")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds 1, 2, 3, ... (int) by the order among the rows of a key; null is a key like any other.

    If no key has more than hot_rows rows, a window numbers them. Otherwise all rows are dealt by range of key and
    order, which cuts a hot key into parts as even as the rest, and numbered within (part, key). Only the first and
    the last key of a part can go on in another, so the sums of the parts before are needed for two keys a part.
    The order should tell all rows of a key apart, or equal rows may be numbered either way. df is read three times
    then, so give a written table if it is costly.
    """
    if df.groupBy(*keys).count().where(F.col("count") > hot_rows).isEmpty():
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    scratch = Scratch(df.sparkSession)
    dealt = scratch.keep(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    key = F.struct(*keys)
    ends = dealt.groupBy("__part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.array("a", "b")).alias("e")).distinct()
    ends = F.broadcast(ends.select(*(F.col(f"e.{k}").alias(f"__{k}") for k in keys)))  # two rows a part at the most
    same = functools.reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    sizes = dealt.join(ends, same, "left_semi").groupBy("__part", *keys).agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(W.partitionBy(*keys).orderBy("__part")) - F.col("n"))
    before = F.broadcast(before.select(F.col("__part").alias("__at"), "__before", *(F.col(k).alias(f"__{k}") for k in keys)))
    nth = dealt.withColumn("__nth", F.row_number().over(W.partitionBy("__part", *keys).orderBy(*order)))
    out = nth.join(before, same & (F.col("__part") == F.col("__at")), "left")
    return out.withColumn(name, (F.col("__nth") + F.coalesce("__before", F.lit(0))).cast("int")).select(*df.columns, name)
