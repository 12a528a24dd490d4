"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and a join, so a hub with many neighbours is pre-aggregated before the
shuffle and its join is one that adaptive execution can split. The loop ends when all edges lead from a
smallest node to others that have no further edge. Each round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether no node is below two others, or both below and above others."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = ends.union(edges.select(F.col("b").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")))
    return ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of every node that has an edge; a component is named by its smallest id.

    edges: two columns of one type, in any order and repeated at will; loops and null ends are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    x, y = (F.col(f"`{c}`") for c in edges.columns[:2])
    now = scratch.keep(edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct(), "edges")
    while not _stars(now):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = scratch.hold(now.join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        rest = large.join(least, "b").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = scratch.keep(rest.union(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        scratch.drop(now, large)
        now = after
    found = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    out = scratch.keep(found.union(now.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct(), "components")
    scratch.drop(now)
    return out
