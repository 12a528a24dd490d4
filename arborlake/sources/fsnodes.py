"""Scans of a file system.

`scan` walks by a frontier: a table of folders that are still to be listed, dealt anew in every round. A task lists
the folders that it was dealt and goes on below them until it has made `budget` rows; what it has not come to is the
next frontier. So a deep or wide sub-tree is shared out again in each round, however it hangs, and a chain of folders
goes down by many levels a round. Rounds are written to the shared folder. One folder is listed by one task.

`spark.read.format("fsnodes").option("path", root).load()` is the plain data source: the driver looks for folders
level by level until there are enough to deal out, and tasks walk their own sub-trees. Options: path, followLinks
(false), partitions (64). Both send Arrow batches.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.duplicates import PREFIX_BYTES, equal_digests, size_candidates
from ..operators.rollup import build_nodes
from ..plans.scratch import Scratch
from ..plans.workers import can_import, ready

SCHEMA = "full_path string, is_directory boolean, size_bytes bigint, modified_utc timestamp, access_denied boolean"
#: Rows that a task makes in a round before it hands the rest on; the same while there are fewer folders than tasks;
#: rows of an Arrow batch.
BUDGET, FIRST_BUDGET, BATCH = 100_000, 1_000, 10_000
_TIME = pa.timestamp("us", "UTC")


def _when(stat: os.stat_result) -> int | None:
    """Microseconds; years that a timestamp cannot hold are unknown."""
    micros = stat.st_mtime_ns // 1000
    return micros if abs(micros) < 250_000_000_000_000_000 else None


def _file_row(entry):
    try:
        s = entry.stat(follow_symlinks=True)
        return entry.path, False, s.st_size, _when(s), False
    except OSError:
        return entry.path, False, 0, None, False


def list_folder(path: bytes, follow: bool) -> tuple[list, list[bytes], bool]:
    """(rows of files, sub-folders, whether all could be read). Links to folders are left out unless followed.

    An entry that cannot be looked at, such as a link to itself, is a file of size 0; if listing breaks off, what was
    read before counts.
    """
    files, folders = [], []
    try:
        entries = os.scandir(path)
    except OSError:
        return files, folders, False
    with entries:
        while True:
            try:
                e = next(entries, None)
            except OSError:
                return files, folders, False
            if e is None:
                return files, folders, True
            try:
                folder, link = e.is_dir(follow_symlinks=True), e.is_symlink()
            except OSError:
                folder = link = False
            if not folder:
                files.append(_file_row(e))
            elif follow or not link:
                folders.append(e.path)


def folder_row(path: bytes, complete: bool):
    try:
        when = _when(os.stat(path))
    except OSError:
        when = None
    return path, True, 0, when, not complete


def _arrow(rows: list) -> pa.RecordBatch:
    """Names that are no UTF-8 show a mark for each byte that is none."""
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.bool_(), pa.int64(), _TIME, pa.bool_())
    cols[0] = [p.decode("utf-8", "replace") for p in cols[0]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["full_path", "is_directory", "size_bytes", "modified_utc", "access_denied"])


def walk_from(folders: list[bytes], follow: bool, budget: int | None):
    """Yields (rows, folders not come to). Without a budget all that is below is walked. Of folders that links lead to
    twice the first one counts."""
    rows, seen, made, queue = [], set(), 0, deque(folders)
    while queue and (budget is None or made < budget):
        folder = queue.popleft()
        if follow:
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
        files, below, complete = list_folder(folder, follow)
        rows += [folder_row(folder, complete), *files]
        made += 1 + len(files)
        queue += below
        while len(rows) >= BATCH:
            yield rows[:BATCH], []
            rows = rows[BATCH:]
    yield rows, list(queue)


class _Part(InputPartition):
    def __init__(self, tops, roots):
        self.tops, self.roots = tops, roots


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = root_of(options.get("path"))
        self.follow = str(options.get("followLinks", "false")).lower() == "true"
        self.n = int(options.get("partitions", 64))

    def partitions(self):
        tops, level = [], [os.fsencode(self.root)]
        while level and len(level) < self.n and len(tops) < 100 * self.n:
            tops += level
            level = [below for folder in level for below in list_folder(folder, self.follow)[1]]
        return [_Part(tops[i :: self.n], level[i :: self.n]) for i in range(min(self.n, max(len(tops), len(level))))]

    def read(self, partition):
        for folder in partition.tops:
            files, _, complete = list_folder(folder, self.follow)
            yield _arrow([folder_row(folder, complete), *files])
        for rows, _ in walk_from(partition.roots, self.follow, None):
            yield _arrow(rows)


class FileSystemNodes(DataSource):
    @classmethod
    def name(cls):
        return "fsnodes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def root_of(path: str | None) -> str:
    """The absolute path of a folder to scan; blank raises ValueError, a missing one FileNotFoundError."""
    if not (path or "").strip():
        raise ValueError("a root path is needed")
    path = os.path.abspath(path)
    if not os.path.isdir(path):
        raise FileNotFoundError(f"no such folder: {path}")
    return path


def _round(budget: int, follow: bool, batches):
    """What a task does in a round. batches: folder."""
    task = TaskContext.get().partitionId()
    dealt = [f for batch in batches for f in batch.column(0).to_pylist()]
    for rows, left in walk_one_level(dealt) if follow else walk_from(dealt, False, budget):
        block, n, k = _arrow(rows), len(rows), len(left)
        columns = [pa.concat_arrays([c, pa.nulls(k, c.type)]) for c in block.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([None] * n + left, pa.binary()), pa.array([task] * (n + k), pa.int32())], [*block.schema.names, "folder", "task"])


def walk(spark: SparkSession, root: str, follow_links: bool = False, partitions: int = 64, budget: int = BUDGET, scratch: Scratch | None = None) -> DataFrame:
    """Rows of SCHEMA for all below a folder, absolute paths, and round and task: who listed them.

    If links are followed, each real folder counts once, at the first of its paths in the first round that meets it;
    a round is then one level.
    """
    scratch = scratch or Scratch(spark)
    rounds, first = [], os.fsencode(root_of(root))
    frontier = spark.createDataFrame([(bytearray(first),)], "folder binary")
    seen = spark.createDataFrame([(bytearray(os.path.realpath(first)),)], "real binary")

    while True:
        n = frontier.count()
        if not n:
            return functools.reduce(DataFrame.union, rounds)
        most = budget if n >= partitions else min(budget, FIRST_BUDGET)
        made = ready(frontier.repartition(min(partitions, n))).mapInArrow(functools.partial(_round, most, follow_links), f"{SCHEMA}, folder binary, task int")
        made = scratch.keep(made, "walk")
        rounds.append(made.where("folder IS NULL").select(*(f.split()[0] for f in SCHEMA.split(", ")), F.lit(len(rounds)).alias("round"), "task"))
        frontier = made.where("folder IS NOT NULL").select("folder")
        if follow_links:
            real = ready(frontier).mapInArrow(_real_paths, "folder binary, real binary").groupBy("real").agg(F.min("folder").alias("folder"))
            new = scratch.keep(real.join(seen, "real", "left_anti"), "frontier")
            seen = seen.union(new.select("real"))
            frontier = new.select("folder")


def walk_one_level(folders: list[bytes]):
    for folder in folders:
        files, below, complete = list_folder(folder, True)
        yield [folder_row(folder, complete), *files], below


def _real_paths(batches):
    for batch in batches:
        real = [os.path.realpath(f) for f in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(real, pa.binary())], ["folder", "real"])


def scan(spark: SparkSession, root: str, follow_links: bool = False, partitions: int = 64, budget: int = BUDGET) -> DataFrame:
    """The nodes below a folder with rolled-up totals; paths are relative to it."""
    base = root_of(root).rstrip("/")
    rows = walk(spark, root, follow_links, partitions, budget)
    rows = rows.withColumn("full_path", F.substring("full_path", F.lit(len(base) + 1), F.length("full_path")))
    rows = rows.withColumn("full_path", F.when(F.col("full_path") == "", "/").otherwise(F.col("full_path")))
    return build_nodes(rows.where("NOT is_directory"), rows.where("is_directory").select("full_path", "modified_utc", "access_denied"), base or "/")


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("fsnodes") known."""
    can_import(spark)
    spark.dataSource.register(FileSystemNodes)


def create_files(files: DataFrame, base: str) -> None:
    """Makes these files below a folder that all tasks can open: full_path, size_bytes, modified_utc and, if known,
    content (else a file of that size that takes no room)."""
    has = "content" in files.columns
    slim = files.select("full_path", "size_bytes", F.unix_timestamp("modified_utc").alias("seconds"), *["content"] * has)

    def make(batches):
        for batch in batches:
            for path, size, seconds, *content in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(base + path), exist_ok=True)
                with open(base + path, "wb") as f:
                    f.write(content[0] or b"") if has else f.truncate(size)
                if seconds is not None:
                    os.utime(base + path, (seconds, seconds))
            yield batch.select(["size_bytes"])

    os.makedirs(base, exist_ok=True)
    ready(slim).mapInArrow(make, "size_bytes bigint").write.format("noop").mode("overwrite").save()


def with_digest(files: DataFrame, base: str = "", most: int | None = None) -> DataFrame:
    """Adds digest, the SHA-256 of a file's first `most` bytes or of all, read in pieces by the tasks; null where it cannot be read.

    files: full_path, size_bytes, modified_utc. Sizes are those found when read, so that a file that changed since
    the scan is held by what it is now.
    """

    def read(batches):
        for pdf in batches:
            digests, sizes = [], []
            for p, size in zip(pdf["full_path"], pdf["size_bytes"]):
                digest, left = hashlib.sha256(), most
                try:
                    with open(base + p, "rb") as f:
                        size = os.fstat(f.fileno()).st_size
                        while piece := f.read(1 << 20 if left is None else min(left, 1 << 20)):
                            digest.update(piece)
                            left = left if left is None else left - len(piece)
                    digests.append(digest.hexdigest())
                except OSError:
                    digests.append(None)
                sizes.append(size)
            yield pdf.assign(size_bytes=sizes, digest=digests)

    slim = files.select("full_path", "size_bytes", "modified_utc")
    return ready(slim).mapInPandas(read, "full_path string, size_bytes bigint, modified_utc timestamp, digest string")


def duplicates(files: DataFrame, base: str = "") -> DataFrame:
    """full_path, size_bytes, modified_utc, digest and copies of every file that has an equal one.

    Only files whose size another one has are opened, for their first 4 KiB, and only those that share these are read
    whole. Paths, sizes and digests are shuffled, contents never.
    """
    head = with_digest(size_candidates(files), base, PREFIX_BYTES).where("digest IS NOT NULL")
    shared = head.groupBy("size_bytes", "digest").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes", "digest")
    whole = with_digest(head.join(shared, ["size_bytes", "digest"], "left_semi"), base).where("digest IS NOT NULL")
    return equal_digests(whole)
