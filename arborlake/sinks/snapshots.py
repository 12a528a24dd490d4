"""Stored scans: Parquet parted by snapshot, bucketed tables, and nested JSON documents, written and read by tasks."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import describe
from ..plans.numbering import rank_within
from ..plans.scratch import Scratch
from ..plans.workers import ready
from ..schema import FORMAT_VERSION, NODES, SNAPSHOTS, as_nodes, fold
from .export import write_lines


def save(nodes: DataFrame, folder: str, snapshot_id: str, taken: datetime | None = None, root_path: str = "/") -> None:
    """Adds a snapshot; one of the same id is replaced."""
    taken = taken or datetime.now(timezone.utc)
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes/snapshot_id={snapshot_id}")
    head = nodes.sparkSession.createDataFrame([(snapshot_id, FORMAT_VERSION, taken, root_path)], SNAPSHOTS)
    head.coalesce(1).write.mode("overwrite").parquet(f"{folder}/headers/{snapshot_id}")


def load(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    return as_nodes(spark.read.schema(NODES).parquet(f"{folder}/nodes/snapshot_id={snapshot_id}"))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SNAPSHOTS).option("recursiveFileLookup", True).parquet(f"{folder}/headers")


def save_table(nodes: DataFrame, name: str, buckets: int = 200) -> None:
    """Stores a snapshot as a table of the catalog, bucketed and sorted by folded path (column key), so that comparing two
    of as many buckets shuffles neither. A snapshot of the same name is replaced."""
    keyed = as_nodes(nodes).withColumn("key", fold(F.col("full_path")))
    keyed.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(name)


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """The nodes of a stored snapshot, with key."""
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


#: What begins a node in a document as write_json and compact serializers write it. A quote within a text is escaped, so no
#: text holds it.
_NODE = '{"Name":'
_CHILDREN = ',"Children":['
_FIELDS = "Name string, FullPath string, IsDirectory boolean, SizeInBytes bigint, FileCount bigint, LastModifiedUtc string, Extension string"
#: What stands before the root, and what may follow the fields of a node: its children, or its end and that of folders around it.
_HEAD = r'^\uFEFF?\s*\{\s*"FormatVersion"\s*:\s*\d+\s*,\s*"TakenUtc"\s*:\s*"[^"\\]*"\s*,\s*"RootPath"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*"Root"\s*:\s*$'
_TAIL = r"^\s*(?:(?:\]\s*\}\s*)+[,}]?)?\s*$"
#: A time that is not known.
_NO_TIME = "0001-01-01T00:00:00"


def write_json(nodes: DataFrame, path: str, taken: datetime | None = None, root_path: str = "/") -> None:
    """Writes a snapshot as one nested JSON document, Root with Children down the tree, a folder's children in the order of
    the walk. Tasks sort and write it: a node is a line, the end of a folder another one that sorts behind all that is in it.
    Depth is not limited. The root must be among the nodes."""
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession)
    taken = taken or datetime.now(timezone.utc)
    held = scratch.keep(nodes.select("full_path", "parent_path", "name", "is_directory", "size_bytes", "file_count", "modified_utc", "extension", "traversal_ord"), "tree")
    # the first of a folder has no comma before it
    nth = rank_within(held, ["parent_path"], [F.col("traversal_ord")], "nth")
    base, root = root_path.rstrip("/"), F.col("full_path") == "/"
    stamp = F.date_format(F.to_utc_timestamp("modified_utc", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = {
        "Name": F.when(root, base.rpartition("/")[2] or root_path).otherwise(F.col("name")), "FullPath": F.when(root, root_path).otherwise(F.concat(F.lit(base), "full_path")), "IsDirectory": F.col("is_directory"),
        "SizeInBytes": F.col("size_bytes"), "FileCount": F.col("file_count"), "LastModifiedUtc": F.coalesce(stamp, F.lit(_NO_TIME)), "Extension": F.col("extension"),
    }
    text = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})
    opened = F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), F.substring(text, F.lit(1), F.length(text) - 1), F.lit(_CHILDREN), F.when(F.col("is_directory"), "").otherwise("]}"))
    starts = nth.select(opened.alias("value"), F.col("traversal_ord").alias("at"), "nth")
    ends = held.where("is_directory").select(F.lit("]}").alias("value"), F.concat("traversal_ord", F.lit("\x02\U0010ffff")).alias("at"), F.lit(0).alias("nth"))
    head = json.dumps({"FormatVersion": FORMAT_VERSION, "TakenUtc": taken.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "RootPath": root_path}, ensure_ascii=False)
    write_lines(starts.union(ends), [F.col("at"), F.col("nth")], path, head[:-1] + ',"Root":', "}\n")
    scratch.drop(held)


def _below(full: Column, base: Column) -> Column:
    """Paths below their root; separators are backslashes unless the root begins with a slash."""
    clean = lambda c: F.rtrim(F.when(base.startswith("/"), c).otherwise(F.replace(c, F.lit("\\"), F.lit("/"))), F.lit("/"))
    below = F.substr(clean(full), F.length(clean(base)) + 1)
    return F.when(below == "", "/").otherwise(below)


def _imported(flat: DataFrame) -> DataFrame:
    """Nodes from base, FullPath and the other fields."""
    when = F.when(~F.col("LastModifiedUtc").startswith("0001"), F.to_timestamp(F.nullif("LastModifiedUtc", F.lit(""))))
    return describe(
        flat.select(
            _below(F.col("FullPath"), F.col("base")).alias("full_path"), F.coalesce("IsDirectory", F.lit(False)).alias("is_directory"), F.coalesce("SizeInBytes", F.lit(0)).alias("size_bytes"),
            F.coalesce("FileCount", F.lit(0)).alias("file_count"), when.alias("modified_utc"), F.lit(False).alias("access_denied"),
        ),
        "imported",
    )


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of nested JSON snapshots (Root with Children down the tree), a file or a folder of them.

    A document is cut where its nodes begin, so tasks read one document side by side and hold a node at a time: each
    node bears its whole path, and needs no other. That works where every node begins with its name and ends with its
    children, without blanks at its start, and nothing follows the root. One pass checks this, and that all that is
    opened is closed; if a document does not stand up to it (other orders of fields, indented, broken off), all are
    read whole, one a row, and flattened on the executors with a stack. Depth is not limited either way.
    A document that is null or has no root raises ValueError.
    """
    cut = spark.read.text(path, lineSep=_NODE).select("value", F.col("_metadata.file_path").alias("file"))
    node = F.from_json(F.concat(F.lit(_NODE), F.substring_index("value", _CHILDREN, 1), F.lit("}")), _FIELDS + ", bad string", {"columnNameOfCorruptRecord": "bad"})
    rest = F.substring(F.col("value"), F.instr("value", F.lit(_CHILDREN)) + len(_CHILDREN), F.length("value"))
    parts = cut.select("file", F.col("value").rlike(_HEAD).alias("head"), node.alias("n"), F.when(F.instr("value", F.lit(_CHILDREN)) > 0, rest).alias("rest"))
    is_node = F.col("n.bad").isNull() & F.col("n.FullPath").isNotNull() & F.coalesce(F.col("rest").rlike(_TAIL), F.lit(False))
    closed = F.length("rest") - F.length(F.replace("rest", F.lit("}"), F.lit("")))
    checks = parts.groupBy("file").agg(
        F.count_if("head").alias("heads"), F.count_if(~F.col("head") & ~is_node).alias("odd"), F.count_if(~F.col("head")).alias("nodes"),
        F.sum(F.when(~F.col("head"), closed)).alias("closed"), F.min_by("n.FullPath", F.length("n.FullPath")).alias("base"),
    )
    scratch = Scratch(spark)
    checks = scratch.keep(checks, "documents")
    sound = (F.col("heads") == 1) & (F.col("odd") == 0) & (F.col("nodes") > 0) & (F.col("closed") == F.col("nodes") + 1)
    files, good = checks.agg(F.count("*"), F.count_if(sound)).first()
    if files != len(set(cut.inputFiles())) or good != files:
        scratch.drop(checks)
        return _import_whole(spark, path)
    bases = checks.select("file", "base")
    if files <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    return _imported(parts.where("NOT head").select("file", "n.*").join(bases, "file"))


#: Up to so many documents, of a path each, the paths of their roots are sent to all tasks.
BROADCAST_FILES = 10_000


def _import_whole(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)

    def flatten(batches):
        import pandas as pd

        columns = ["base", "FullPath", "IsDirectory", "SizeInBytes", "FileCount", "LastModifiedUtc"]
        for pdf in batches:
            for value in pdf["value"]:
                root = (json.loads(value.removeprefix("\ufeff")) or {}).get("Root")
                if not root:
                    raise ValueError("the snapshot is empty")
                stack, rows = [root], []
                while stack:
                    n = stack.pop()
                    stack += n.get("Children") or []
                    folder = n.get("IsDirectory", n.get("NodeType") in (0, "Directory"))
                    rows.append((root["FullPath"], n["FullPath"], folder, n.get("SizeInBytes", 0), n.get("FileCount", 0), n.get("LastModifiedUtc") or ""))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return _imported(ready(text).mapInPandas(flatten, "base string, FullPath string, IsDirectory boolean, SizeInBytes bigint, FileCount bigint, LastModifiedUtc string"))
