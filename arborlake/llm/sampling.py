"""Bounded samples of labelled documents to fit classifiers on; everything else reads all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(rows: DataFrame, label: str, per_label: int, most_chars: int, most_labels: int = 1000, most_rows: int = 10_000) -> list:
    """(text, label) of about `per_label` rows of each label, chosen by the hash of their id.

    rows: doc_id, text, label. Rows without a label or a text are not learnt from; nor are labels beyond the
    most_labels most frequent. With many labels fewer rows of each are taken: about most_rows in all, and never
    more than twice as many. Texts are taken whole, by the hash of their id, as long as those of a label have
    `most_chars` characters on average; only a text of more than all these characters is never taken.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    if not counts:
        return []
    per_label = max(1, min(per_label, most_rows // len(counts)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), int(min(1_000_000, 1_100_000 * per_label // n))).otherwise(share)
    budget = per_label * most_chars
    size = F.length("text").cast("long")
    picked = rows.where((place < share) & (size <= budget)).select("text", label, size.alias("size"), place.alias("place"), F.xxhash64("doc_id", "text").alias("tie"))
    order = W.partitionBy(label).orderBy("place", "tie")
    picked = picked.withColumns({"nth": F.row_number().over(order), "sum": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
    return [(r[0], r[1]) for r in picked.where((F.col("nth") <= 2 * per_label) & (F.col("sum") <= budget)).select("text", label).collect()]
