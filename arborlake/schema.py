"""The flat tables that everything works on, and shared rules of comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scan: one row per file or folder. traversal_ord sorts as a depth-first walk does, a folder's files first.
NODES = (
    "scan_id string, full_path string, parent_path string, name string, is_directory boolean, depth int, extension string, "
    "size_bytes bigint, file_count bigint, modified_utc timestamp, access_denied boolean, traversal_ord string"
)
SNAPSHOTS = "snapshot_id string, format_version int, taken_utc timestamp, root_path string"
FORMAT_VERSION = 1

#: The image types that have a perceptual hash.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff", ".tif"]

ROOT = "/"


def fold(c: Column) -> Column:
    """The key of comparisons that ignore case."""
    return F.lower(c)


def sort_fold(c: Column) -> Column:
    """The order of comparisons that ignore case."""
    return F.upper(c)


def modified_or_unknown(c: Column) -> Column:
    """An unknown time compares as the year 1."""
    return F.coalesce(c, F.to_timestamp(F.lit("0001-01-01 00:00:00")))


def columns_of(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def as_nodes(df: DataFrame) -> DataFrame:
    return df.select(*columns_of(NODES))
