"""Totals of folders, and the patching of a scan after deletes and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions import paths as P
from ..plans.scratch import Scratch
from ..schema import as_nodes


def build_nodes(leaves: DataFrame, folders: DataFrame | None = None, scan_id: str = "scan") -> DataFrame:
    """The nodes of a scan with rolled-up totals.

    leaves: full_path, size_bytes, modified_utc. folders: full_path, and if known modified_utc and
    access_denied; folders above a leaf or folder are added. Empty folders have totals of 0.
    """
    files = leaves.select(
        "full_path", "size_bytes", "modified_utc", F.lit(1).cast("bigint").alias("file_count"), F.lit(False).alias("is_directory"), F.lit(False).alias("access_denied")
    )
    # every leaf adds to all folders above it; partial sums meet before the shuffle
    above = files.select(F.explode(P.ancestors_of(F.col("full_path"))).alias("full_path"), "size_bytes", "file_count")
    zero = F.lit(0).cast("bigint")
    unknown, denied = F.lit(None).cast("timestamp"), F.lit(False)
    above = above.withColumns({"modified_utc": unknown, "access_denied": denied})
    if folders is not None:
        has = folders.columns
        own = folders.select("full_path", (F.col("modified_utc") if "modified_utc" in has else unknown).alias("modified_utc"), (F.col("access_denied") if "access_denied" in has else denied).alias("access_denied"))
        up = own.select(F.explode(P.ancestors_of(F.col("full_path"))).alias("full_path"), unknown.alias("modified_utc"), denied.alias("access_denied"))
        empty = own.union(up).select("full_path", zero.alias("size_bytes"), zero.alias("file_count"), "modified_utc", "access_denied")
        above = above.unionByName(empty)
    totals = above.groupBy("full_path").agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum("file_count").alias("file_count"), F.max("modified_utc").alias("modified_utc"), F.max("access_denied").alias("access_denied")
    )
    return describe(files.unionByName(totals.withColumn("is_directory", F.lit(True))), scan_id)


def describe(rows: DataFrame, scan_id: str) -> DataFrame:
    """Adds the columns that follow from the path."""
    path, name = F.col("full_path"), P.name_of(F.col("full_path"))
    return as_nodes(
        rows.withColumns(
            {
                "scan_id": F.lit(scan_id),
                "parent_path": P.parent_of(path),
                "name": name,
                "depth": P.depth_of(path),
                "extension": F.when(~F.col("is_directory"), P.extension_of(name)),
                "traversal_ord": P.traversal_key(path, F.col("is_directory")),
            }
        )
    )


def scan_totals(nodes: DataFrame) -> DataFrame:
    """One row: files, folders (the root among them), bytes and unreadable folders."""
    return nodes.agg(
        F.count_if(~F.col("is_directory")).alias("files"),
        F.count_if("is_directory").alias("folders"),
        F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
        F.count_if("access_denied").alias("unreadable"),
    )


def root_total(nodes: DataFrame) -> DataFrame:
    """One row: the size of the root."""
    return nodes.where("depth = 0").agg(F.coalesce(F.max("size_bytes"), F.lit(0)).alias("root_bytes"))


def with_root_total(nodes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Adds the root's size, which is one row, to all rows; a root without size counts as the row's own."""
    rows = nodes if rows is None else rows
    out = rows.crossJoin(F.broadcast(root_total(nodes)))
    return out.withColumn("root_bytes", F.when(F.col("root_bytes") > 0, F.col("root_bytes")).otherwise(F.col("size_bytes")))


def ancestors(nodes: DataFrame, path: str) -> DataFrame:
    """The folders from the root down to a node (a file's own folder is the last)."""
    chain = nodes.where(F.col("full_path") == path).select(F.explode(P.ancestors_of(F.col("full_path"))).alias("full_path"))
    folder = nodes.where((F.col("full_path") == path) & F.col("is_directory")).select("full_path")
    return nodes.join(chain.union(folder), "full_path", "left_semi")


#: Up to so many paths are broadcast, some 10 MB.
MOST_PATHS = 50_000


def _narrow(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(MOST_PATHS + 1).count() <= MOST_PATHS else df


def remove_nodes(nodes: DataFrame, paths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The scan without these nodes and what is below them, totals of the folders above reduced.

    paths: full_path. The root and unknown paths are ignored, and paths below another count once. The removed tops are
    held by depth, and a node goes if its ancestor of one of these depths is among them: one anti-join a depth, so no
    node is multiplied by its ancestors, and with few tops nodes are not shuffled at all. Only folders above a top change.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    path = F.col("full_path")
    gone = paths.select("full_path").where("full_path <> '/'").distinct()
    gone = scratch.keep(nodes.select("full_path", "size_bytes", "file_count").join(_narrow(gone), "full_path"), "gone")
    up = gone.select("full_path", F.explode(P.ancestors_of(path)).alias("above"))
    nested = up.join(gone.select(path.alias("above")), "above", "left_semi").select("full_path").distinct()
    top = scratch.keep(gone.join(nested, "full_path", "left_anti").withColumn("depth", P.depth_of(path)), "tops")
    loss = top.select(F.explode(P.ancestors_of(path)).alias("full_path"), "size_bytes", "file_count")
    loss = scratch.keep(loss.groupBy("full_path").agg(F.sum("size_bytes").alias("lost_bytes"), F.sum("file_count").alias("lost_files")), "loss")
    left, steps = nodes, F.split(path, "/")
    for depth in sorted(r.depth for r in top.select("depth").distinct().collect()):  # as many as folders are deep
        at = _narrow(top.where(F.col("depth") == depth).select(path.alias("__top")))
        own = F.when(F.size(steps) > depth, F.array_join(F.slice(steps, 1, depth + 1), "/"))
        left = left.join(at, own == F.col("__top"), "left_anti")
    left = left.join(_narrow(loss), "full_path", "left")
    minus = lambda a, b: (F.col(a) - F.coalesce(F.col(b), F.lit(0))).alias(a)
    return left.select(*(minus(c, {"size_bytes": "lost_bytes", "file_count": "lost_files"}[c]) if c in ("size_bytes", "file_count") else F.col(c) for c in nodes.columns))


def with_shares(nodes: DataFrame) -> DataFrame:
    """Adds share_bp, the share of the root's size in hundredths of a per cent, as it is now."""
    return with_root_total(nodes).withColumn("share_bp", fmt.basis_points(F.col("size_bytes"), F.col("root_bytes"))).drop("root_bytes")


def rename_nodes(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """The scan with files renamed. renames: full_path, new_path. Totals do not change; folders keep their names."""
    out = nodes.join(renames.select("full_path", F.col("new_path").alias("__new")), "full_path", "left")
    new = F.when(~F.col("is_directory"), F.col("__new"))
    renamed = out.withColumn("full_path", F.coalesce(new, F.col("full_path"))).drop("__new")
    name = P.name_of(F.col("full_path"))
    return as_nodes(
        renamed.withColumns(
            {
                "name": name,
                "parent_path": P.parent_of(F.col("full_path")),
                "extension": F.when(~F.col("is_directory"), P.extension_of(name)),
                "traversal_ord": P.traversal_key(F.col("full_path"), F.col("is_directory")),
            }
        )
    )


def children(nodes: DataFrame, parent: str) -> DataFrame:
    """The children of a folder."""
    return nodes.where(F.col("parent_path") == parent)


def by_size(*ties: Column) -> list[Column]:
    """Largest first; ties in the order of the walk."""
    return [F.desc("size_bytes"), *(ties or [F.col("traversal_ord")])]
