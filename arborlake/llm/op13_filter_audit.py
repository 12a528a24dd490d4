"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

A document matters only by its part, the set of filters that it fails and its labels. Documents are counted by
these first; the counts then go to the 80 edges of the lattice of filter sets: an edge leads from the set of
filters that were applied to the next filter. An order of the filters is a path of edges, so the 600 steps of
all 120 orders are one join of the edges to a fixed table of steps.

The duplicate filter needs the smallest id of each text. Copies are counted by (text digest, part, failures,
labels) before they are shuffled by the digest, so a text with many copies is a few rows.

Defined cases: a null text is the empty text, and equal to it; a null lang and an empty one are one part; a
document with several rows of labels is good, or toxic, if any row says so, and without labels it is neither; a
row with a null id has no labels, is no duplicate and makes no other text one; repeated rows of one id count as
often as they come, and none is a duplicate of the others; texts may be of any length and are read whole; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: The filters, each a bit of a document's failures, in this order.
NAMES = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_DUPLICATE = 1 << NAMES.index("E")
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, fails (bits of all five filters), good, toxic and n: documents counted by what they fail.

    docs: doc_id, text, lang. labels: doc_id, quality, toxic.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias({"quality": "good"}.get(c, c))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(yes("quality"), yes("toxic"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "fails", "digest", no("good"), no("toxic"))
    alike = ["digest", "part", "fails", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = scratch.keep(by_id.groupBy(*alike).agg(F.sum("n").alias("n"), least.alias("least"), nameless.alias("nameless")), "copies")
    first = copies.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    original = F.coalesce(F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")), F.lit(0)) + F.col("nameless")
    split = copies.join(first, "digest").select("part", "good", "toxic", F.inline(F.array(F.struct("fails", original.alias("n")), F.struct((F.col("fails") + _DUPLICATE).alias("fails"), (F.col("n") - original).alias("n")))))
    return split.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counts: DataFrame) -> DataFrame:
    """part, applied (bits) and filter (a bit), and the counts of each of the 80 edges. counts: failure_counts()."""
    edges = [(applied, 1 << k) for k in range(len(NAMES)) for applied in range(1 << len(NAMES)) if not applied >> k & 1]
    every = F.inline(F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("filter")) for a, f in edges)))
    rows = counts.select("*", every)
    gone, fails = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("filter")) != 0
    here = ~gone & fails
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    sums = (n(~gone & ~fails), n(here), n(gone & fails), n(F.col("fails") == F.col("filter")), n(here & F.col("good")), n(here & F.col("toxic")))
    return rows.groupBy("part", "applied", "filter").agg(*(s.alias(c) for s, c in zip(sums, _COUNTS)))


def order_steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied and filter: the five steps of each of the 120 orders."""
    steps = []
    for order in permutations(range(len(NAMES))):
        applied = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(NAMES[i] for i in order), step, applied, 1 << k))
            applied |= 1 << k
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """part, filter_order, step and the counts of each step; shapley is what its filter removes over all orders."""
    scratch = scratch or Scratch(docs.sparkSession)
    edges = scratch.keep(lattice_edges(failure_counts(docs, labels, scratch)), "edges")
    steps = F.broadcast(order_steps(docs.sparkSession))  # 600 rows
    paths = edges.join(steps, ["applied", "filter"])
    shapley = paths.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return paths.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *_COUNTS, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails FROM f),
k(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
u AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
v AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS f, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS done FROM u),
g AS (SELECT part, filter_order, step, f, count(*) FILTER (fails & (done | f) = 0) AS kept, count(*) FILTER (fails & done = 0 AND fails & f <> 0) AS removed,
  count(*) FILTER (fails & done <> 0 AND fails & f <> 0) AS redundant, count(*) FILTER (fails = f) AS unique_fails,
  count(*) FILTER (fails & done = 0 AND fails & f <> 0 AND good) AS good_lost, count(*) FILTER (fails & done = 0 AND fails & f <> 0 AND toxic) AS toxic_lost
  FROM m, v GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
