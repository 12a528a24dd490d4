"""Comparison of two scans: what was added, removed, changed in size, moved or renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions import paths as P
from ..plans.numbering import HOT_ROWS, rank_within
from ..plans.scratch import Scratch
from ..schema import fold


def _by_path(nodes: DataFrame) -> DataFrame:
    """The nodes below the root by folded path. Of paths that differ in case alone the later node's values
    hold, under the first one's spelling. A stored snapshot brings its key along and is grouped as it lies."""
    key = F.col("key") if "key" in nodes.columns else fold(F.col("full_path")).alias("key")
    row = F.struct("name", "is_directory", "size_bytes", F.coalesce("extension", F.lit("")).alias("extension"), "traversal_ord")
    grouped = nodes.where("depth > 0").groupBy(key).agg(
        F.min_by("full_path", "traversal_ord").alias("full_path"), F.max_by(row, "traversal_ord").alias("r")
    )
    return grouped.select("key", "full_path", "r.*")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every path that was added, removed or has another size. Times and kinds alone are no change.

    kind, full_path, name, is_directory, extension, old_bytes, new_bytes, delta_bytes, traversal_ord.
    """
    old, new = _by_path(before), _by_path(after)
    both = old.select("key", F.struct(*old.columns[1:]).alias("o")).join(new.select("key", F.struct(*new.columns[1:]).alias("n")), "key", "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.size_bytes") != F.col("n.size_bytes"), "changed")
    zero = F.lit(0).cast("bigint")
    out = both.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("r", F.coalesce("n", "o"))
    out = out.select(
        "kind", "r.full_path", "r.name", "r.is_directory", "r.extension", "r.traversal_ord",
        F.coalesce("o.size_bytes", zero).alias("old_bytes"), F.coalesce("n.size_bytes", zero).alias("new_bytes"),
    )
    return out.withColumn("delta_bytes", F.col("new_bytes") - F.col("old_bytes"))


def _matched(removed: DataFrame, added: DataFrame, key: list[str], tier: int, hot_rows: int) -> DataFrame:
    """Pairs the n-th removed with the n-th added node of a key, in the order of the walk."""
    number = lambda df, side: rank_within(df, key, [F.col("traversal_ord")], "nth", hot_rows).select(*key, "nth", F.struct("full_path", "name", "is_directory", F.greatest("old_bytes", "new_bytes").alias("size")).alias(side))
    return number(removed, "o").join(number(added, "n"), [*key, "nth"]).select("o", "n", F.lit(tier).alias("tier"))


def moves(diff: DataFrame, scratch: Scratch | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """old_path, new_path, old_name, new_name, is_directory, size_bytes, tier and move_kind.

    First nodes of one name, size and kind are paired, then of the rest files of one extension and size
    above 0. Both compare case. A key may hold any number of nodes.
    """
    scratch = scratch or Scratch(diff.sparkSession)
    diff = scratch.keep(diff.where("kind <> 'changed'"), "unmatched")
    size = F.greatest("old_bytes", "new_bytes")
    rows = diff.withColumn("size", size)
    removed, added = rows.where("kind = 'removed'"), rows.where("kind = 'added'")
    first = _matched(removed, added, ["name", "size", "is_directory"], 1, hot_rows)
    left = lambda df, side: df.where("NOT is_directory AND size > 0").join(first.select(F.col(f"{side}.full_path").alias("full_path")), "full_path", "left_anti")
    second = _matched(left(removed, "o"), left(added, "n"), ["extension", "size"], 2, hot_rows)
    both = first.unionByName(second).select(
        F.col("o.full_path").alias("old_path"), F.col("n.full_path").alias("new_path"), F.col("o.name").alias("old_name"), F.col("n.name").alias("new_name"),
        F.col("o.is_directory").alias("is_directory"), F.col("o.size").alias("size_bytes"), "tier",
    )
    renamed = F.col("old_name") != F.col("new_name")
    moved = fold(P.parent_of(F.col("old_path"))) != fold(P.parent_of(F.col("new_path")))
    return both.withColumn("move_kind", F.when(renamed & moved, "Moved & renamed").when(renamed, "Renamed").otherwise("Moved"))


def without_moves(diff: DataFrame, moved: DataFrame) -> DataFrame:
    """The changes that no move explains."""
    gone = moved.select(F.lit("removed").alias("kind"), F.col("old_path").alias("full_path")).union(moved.select(F.lit("added").alias("kind"), F.col("new_path").alias("full_path")))
    return diff.join(gone, ["kind", "full_path"], "left_anti")


def compare(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unexplained changes, and moves."""
    scratch = Scratch(before.sparkSession)
    diff = scratch.keep(changes(before, after), "changes")
    moved = moves(diff, scratch)
    return without_moves(diff, moved), moved


def net_delta(rest: DataFrame) -> DataFrame:
    """One row. net_delta_reference adds folders and the files below them alike, as published tools show it;
    net_delta_bytes adds files only."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return rest.agg(
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "removed").alias("removed"),
        F.count_if(F.col("kind") == "changed").alias("changed"),
        total(F.col("delta_bytes")).alias("net_delta_reference"),
        total(F.when(~F.col("is_directory"), F.col("delta_bytes"))).alias("net_delta_bytes"),
    )


def order_of(kind: str) -> list[Column]:
    """Added by new size, removed by old, changed by the size of the change, ties in the order of the walk;
    moved (the rows of moves) by size, ties by the old path."""
    if kind == "moved":
        return [F.desc("size_bytes"), F.col("old_path")]
    by = {"added": F.col("new_bytes"), "removed": F.col("old_bytes"), "changed": F.abs("delta_bytes")}[kind]
    return [by.desc(), F.col("traversal_ord")]


def top(rest: DataFrame, kind: str, n: int = 20) -> DataFrame:
    return rest.where(F.col("kind") == kind).orderBy(*order_of(kind)).limit(n)


def change_texts(rest: DataFrame) -> DataFrame:
    """Adds the texts that a report shows."""
    return rest.withColumns({"delta_text": fmt.signed_bytes(F.col("delta_bytes")), "size_text": fmt.size_change(F.col("old_bytes"), F.col("new_bytes"))})
