"""Exact duplicates: candidates are narrowed by size, then by the digest of the first 4 KiB, then by that of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import HOT_ROWS, rank_within
from ..plans.scratch import Scratch
from ..schema import fold, modified_or_unknown

#: Bytes of the first digest.
PREFIX_BYTES = 4096
#: Up to so many shared sizes, 8 bytes each, are broadcast; beyond that all files are digested where they are read.
MOST_SIZES = 1_000_000


def size_candidates(files: DataFrame) -> DataFrame:
    """Files of a size above 0 that another file has. files: full_path, size_bytes, modified_utc and more."""
    some = files.where("size_bytes > 0")
    shared = some.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes")
    return some.join(shared, "size_bytes", "left_semi")


def duplicate_files(files: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """full_path, size_bytes, modified_utc and digest of every file that has an equal one.

    files has content (binary; null is unreadable and left out). Three stages, each over what the one before left:
    sizes that two files have, which reads no content; of these files, equal digests of the first 4 KiB; of these, equal
    digests of all. Both digests are taken in one pass where the content is read, the second one only of files longer
    than 4 KiB, and written with the path: contents are never shuffled, and no digest is taken twice. For files that
    are not in a table, `fsnodes.duplicates` reads no more than it needs.
    """
    scratch = scratch or Scratch(files.sparkSession)
    columns = ["full_path", "size_bytes", "modified_utc"]
    sized = files.withColumn("size_bytes", F.octet_length("content").cast("bigint")).where("size_bytes > 0")
    shared = sized.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes")
    shared = scratch.keep(shared, "sizes")
    few = shared.limit(MOST_SIZES + 1).count() <= MOST_SIZES
    some = sized.join(F.broadcast(shared), "size_bytes", "left_semi") if few else sized
    head = F.sha2(F.substring("content", 1, PREFIX_BYTES), 256)
    whole = F.when(F.col("size_bytes") <= PREFIX_BYTES, F.col("head")).otherwise(F.sha2("content", 256))
    digests = scratch.keep(some.withColumn("head", head).select(*columns, "head", whole.alias("digest")), "digests")
    alike = digests.groupBy("size_bytes", "head").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes", "head")
    return equal_digests(digests.join(alike, ["size_bytes", "head"], "left_semi").drop("head"))


def to_hash(files: DataFrame) -> DataFrame:
    """One row: how many files have to be read."""
    return size_candidates(files).agg(F.count("*").alias("files"))


def equal_digests(whole: DataFrame) -> DataFrame:
    """The files whose size and digest another one has."""
    columns = ["full_path", "size_bytes", "modified_utc"]
    groups = whole.groupBy("size_bytes", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return whole.join(groups, ["size_bytes", "digest"]).select(*columns, "digest", "copies")


def keep_plan(duplicates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds rank (the oldest file, then the first path, is 1 and kept) and selected (to be deleted)."""
    ranked = rank_within(duplicates, ["size_bytes", "digest"], [modified_or_unknown(F.col("modified_utc")), F.col("full_path")], hot_rows=hot_rows)
    return ranked.withColumn("selected", F.col("rank") > 1)


def groups(duplicates: DataFrame) -> DataFrame:
    """One row per group: copies, wasted bytes and the file kept; the most waste first when ordered by it."""
    first = F.min(F.struct(modified_or_unknown(F.col("modified_utc")).alias("t"), F.col("full_path").alias("p")))
    return duplicates.groupBy("size_bytes", "digest").agg(F.count("*").alias("copies"), first["p"].alias("kept_path")).withColumn("wasted_bytes", F.col("size_bytes") * (F.col("copies") - 1))


def by_waste() -> list:
    return [F.desc("wasted_bytes"), F.col("kept_path")]


def guard(plan: DataFrame) -> DataFrame:
    """One row: selected files and bytes, and whether some group would lose all its files."""
    per_group = plan.groupBy("size_bytes", "digest").agg(F.bool_and("selected").alias("all"), F.count_if("selected").alias("n"))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("selected_files"),
        F.coalesce(F.sum(F.col("n") * F.col("size_bytes")), F.lit(0)).alias("selected_bytes"),
        F.coalesce(F.bool_or("all"), F.lit(False)).alias("loses_a_group"),
    )


def delete_plan(plan: DataFrame) -> DataFrame:
    """The paths to delete. Raises ValueError if a group would lose all its files."""
    if guard(plan).first()["loses_a_group"]:
        raise ValueError("a group has all its files selected; one of each has to stay")
    return plan.where("selected").select("full_path", "size_bytes")


def after_delete(duplicates: DataFrame, deleted: DataFrame) -> DataFrame:
    """The duplicates left once these paths (in any case) are gone; groups of one file go too."""
    left = duplicates.withColumn("__key", fold(F.col("full_path"))).join(deleted.select(fold(F.col("full_path")).alias("__key")).distinct(), "__key", "left_anti").drop("__key", "copies")
    still = left.groupBy("size_bytes", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return left.join(still, ["size_bytes", "digest"])
