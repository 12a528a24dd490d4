"""Batch renames: preview with errors, plan, and opt-in execution on the driver's file system."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions import paths as P
from ..functions.patterns import check, replacement
from ..plans.numbering import HOT_ROWS, number_rows, rank_within
from ..plans.scratch import Scratch
from ..schema import fold


@dataclass(frozen=True)
class RenameOptions:
    """Base name: find and replace, then prefix, suffix and counter around it; the extension stays."""

    find: str = ""
    is_regex: bool = False
    replace: str = ""
    prefix: str = ""
    suffix: str = ""
    use_counter: bool = False
    counter_start: int = 1
    counter_step: int = 1
    counter_digits: int = 2


#: Error texts of a preview.
EMPTY, COLLIDES, EXISTS = "the new name is empty", "collides with another new name in this batch", "a file with this name exists"


#: A name of nothing but white space is empty.
BLANKS = r"^[\s\p{Z}]+$"


def preview(batch: DataFrame, options: RenameOptions, existing: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """full_path, ord, new_name, new_path and error of every file. batch: full_path, ord and, if known, is_directory;
    folders are left out.

    An empty base name is an error and its path counts for no collision; then of equal new paths (in any
    case) the second and later ones are errors; then paths in `existing` that are not in the batch.
    The counter goes on over errors.
    """
    if "is_directory" in batch.columns:
        batch = batch.where(~F.col("is_directory"))
    path = F.col("full_path")
    folder, name = P.parent_of(path), P.name_of(path)
    base, ext = P.base_of(name), P.extension_of(name)
    if options.find:
        if options.is_regex:
            base = F.regexp_replace(base, check(options.find), replacement(options.replace, options.find))
        else:
            base = F.replace(base, F.lit(options.find), F.lit(options.replace))
    rows = batch.select("full_path", "ord", folder.alias("folder"), base.alias("base"), ext.alias("ext"))
    counter = F.lit("")
    if options.use_counter:
        rows = number_rows(rows, F.col("ord"))
        counter = fmt.pad_counter(F.lit(options.counter_start) + F.lit(options.counter_step) * (F.col("nth") - 1), options.counter_digits)
    stem = F.concat(F.lit(options.prefix), F.col("base"), F.lit(options.suffix), counter)
    rows = rows.withColumn("stem", stem).withColumn("new_name", F.concat("stem", "ext")).withColumn("new_path", P.combine(F.col("folder"), F.col("new_name")))
    rows = rows.withColumn("empty", F.regexp_replace("stem", BLANKS, "") == "").withColumn("key", fold(F.col("new_path")))
    rows = rank_within(rows, ["key", "empty"], [F.col("ord")], "again", hot_rows)
    rows = rows.withColumn("again", ~F.col("empty") & (F.col("again") > 1))
    taken = F.lit(False)
    if existing is not None:
        others = existing.select(fold(F.col("full_path")).alias("key")).distinct().join(batch.select(fold(F.col("full_path")).alias("key")).distinct(), "key", "left_anti")
        rows = rows.join(others.withColumn("taken", F.lit(True)), "key", "left")
        taken = F.coalesce("taken", F.lit(False))
    error = F.when(F.col("empty"), EMPTY).when(F.col("again"), COLLIDES).when(taken, EXISTS)
    return rows.select("full_path", "ord", "new_name", "new_path", error.alias("error"))


def error_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def plan(rows: DataFrame) -> DataFrame:
    """What applying would do: fail (errors), skip (same path, case and all) or rename."""
    action = F.when(F.col("error").isNotNull(), "fail").when(F.col("full_path") == F.col("new_path"), "skip").otherwise("rename")
    return rows.withColumn("action", action)


def chains(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """How the renames of a preview wait for each other: full_path, new_path, ord, waits, in_cycle and fails_in_order.

    A rename whose new path (in any case) is the old path of another one waits for that one; waits counts the renames that
    have to come first, and is null if they run in a circle or lead into one, which no order can serve without a name in
    between. fails_in_order: one by one in the order of the batch the new path would still be taken, by a rename that comes
    later or by a file of the batch that stays. Of each chain every
    member looks twice as far in every round, so the rounds are the logarithm of the longest chain. All joins are merges by
    hint: paths compress so well that a file of some megabytes is a table of hundreds, which Spark would broadcast.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    acts = plan(rows).select("full_path", "new_path", "ord", "action", fold(F.col("full_path")).alias("at"), fold(F.col("new_path")).alias("next"))
    acts = scratch.keep(acts, "acts")
    moves = acts.where("action = 'rename' AND at <> next").drop("action")
    there = moves.select(F.col("at").alias("next"), F.col("ord").alias("next_ord"), F.lit(False).alias("stays"))
    stays = acts.where("action <> 'rename'").groupBy(F.col("at").alias("next")).agg(F.max("ord").alias("next_ord")).withColumn("stays", F.lit(True))
    links = moves.hint("merge").join(there.unionByName(stays), "next")
    links = links.select("at", "next", F.when(F.col("stays"), 0).otherwise(1).cast("bigint").alias("waits"), (F.col("stays") | (F.col("next_ord") > F.col("ord"))).alias("late"))
    ends = links.select("next").hint("merge").join(links.select(F.col("at").alias("next")), "next", "left_anti")
    links = links.unionByName(ends.select(F.col("next").alias("at"), F.lit(None).cast("string").alias("next"), F.lit(0).cast("bigint").alias("waits"), F.lit(False).alias("late")))
    links = scratch.keep(links, "links")
    most, reach = links.count(), 1
    while reach <= most and not links.where("next IS NOT NULL").isEmpty():
        far = links.select(F.col("at").alias("next"), F.col("next").alias("after"), F.col("waits").alias("more"), F.col("late").alias("later"))
        none = F.lit(0).cast("bigint")
        further = links.hint("merge").join(far, "next", "left").select("at", F.col("after").alias("next"), (F.col("waits") + F.coalesce("more", none)).alias("waits"), (F.col("late") | F.coalesce("later", F.lit(False))).alias("late"))
        before, links, reach = links, scratch.keep(further, "links"), 2 * reach
        scratch.drop(before)
    in_cycle = F.col("next").isNotNull()
    found = links.select("at", F.when(~in_cycle, F.col("waits")).alias("waits"), in_cycle.alias("in_cycle"), (F.col("late") | in_cycle).alias("fails_in_order"))
    out = moves.drop("next").hint("merge").join(found, "at", "left").drop("at")
    alone = F.lit(False)
    return out.select("full_path", "new_path", "ord", F.when(F.coalesce("in_cycle", alone), None).otherwise(F.coalesce("waits", F.lit(0))).cast("bigint").alias("waits"), F.coalesce("in_cycle", alone).alias("in_cycle"), F.coalesce("fails_in_order", alone).alias("fails_in_order"))


def apply(rows: DataFrame, really: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """Renames files on the driver's own file system, one by one in the order of the batch; needs really=True.

    Returns the new paths and (path, error) of failures.
    """
    if not really:
        raise ValueError("renaming is opt-in: pass really=True")
    renamed, failed = [], []
    for r in plan(rows).orderBy("ord").toLocalIterator():
        if r.action == "fail":
            failed.append((r.full_path, r.error))
        elif r.action == "rename":
            try:
                if os.path.lexists(r.new_path) and r.new_path.lower() != r.full_path.lower():
                    raise FileExistsError(EXISTS)
                os.rename(r.full_path, r.new_path)
                renamed.append(r.new_path)
            except OSError as e:
                failed.append((r.full_path, str(e)))
    return renamed, failed
