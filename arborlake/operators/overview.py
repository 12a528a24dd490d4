"""Figures of an overview page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..schema import ROOT
from .rollup import by_size, children, with_root_total


def biggest_children(nodes: DataFrame, parent: str = ROOT, n: int = 6) -> DataFrame:
    """The largest children of a folder with size, share of the root, files and kind."""
    top = with_root_total(nodes, children(nodes, parent).orderBy(*by_size()).limit(n))
    share = fmt.basis_points(F.col("size_bytes"), F.col("root_bytes"))
    return top.select(
        "full_path", "name", "size_bytes", fmt.format_bytes(F.col("size_bytes")).alias("size_text"), share.alias("share_bp"), "file_count", fmt.type_label(F.col("is_directory")).alias("kind")
    )


def reclaim_totals(duplicate_groups: DataFrame, similar_groups: DataFrame) -> DataFrame:
    """One row: bytes to be had from duplicates, from similar images, and both."""
    total = lambda df: df.agg(F.coalesce(F.sum("wasted_bytes"), F.lit(0).cast("bigint")).alias("b"))
    both = total(duplicate_groups).select(F.col("b").alias("duplicate_bytes")).crossJoin(F.broadcast(total(similar_groups).select(F.col("b").alias("similar_bytes"))))
    return both.withColumn("total_bytes", F.col("duplicate_bytes") + F.col("similar_bytes"))
