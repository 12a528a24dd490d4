"""Host-level quality rules, in DataFrame functions only.

Per document the rules' figures are counted; per host (the source column) the documents that fail a
rule are counted, the failure rates are shrunk with a beta prior fitted to all hosts by moments, and
a host's verdict is joined back to its documents.

Defined cases: a null or empty text has no words (and fails for having under 50); a null host is no
host, so only the document's own rules judge it; repeated rows count and return once each; ties do
not arise (a host is bad if its rate is strictly above the threshold); texts may be of any length and are read
whole; an empty table gives no rows; only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_checked, table

#: A host whose shrunk failure rate is above this is rejected.
MAX_RATE = 0.5


def rule_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: the counts that the rules look at, base_failed and rule_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    d = d.withColumn("words", F.expr(r"filter(split(translate(t, '\t\n\u000b\u000c\r', '     '), ' '), w -> w != '')"))
    d = d.withColumn("lines", F.expr(r"filter(split(t, '\n'), l -> translate(l, ' \t\u000b\u000c\r', '') != '')"))
    # windows of three words as (hash, place), in the order of their hashes: equal windows stand side by side
    d = d.withColumn(
        "windows",
        F.expr(
            "CASE WHEN size(words) < 4 THEN cast(array() AS array<struct<h:bigint,i:int>>) ELSE "
            "sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))) END"
        ),
    )
    d = d.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(windows, (x, j) -> (j > 0 AND get(windows, j - 1).h = x.h) OR "
            "(j + 1 < size(windows) AND get(windows, j + 1).h = x.h)), x -> x.i))"
        ),
    )
    repeated = F.expr("aggregate(zip_with(places, slice(places, 2, size(places)), (a, b) -> coalesce(least(3, b - a), 3)), 0L, (s, x) -> s + x)")
    d = d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.expr(r"length(translate(t, ' \t\n\u000b\u000c\r', ''))").cast("long").alias("word_chars"),
        F.expr("length(t) - length(translate(t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rule = base | (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    return d.withColumn("base_failed", base).withColumn("rule_failed", rule)


def host_verdicts(figures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, and whether it is rejected."""
    hosts = figures.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("rule_failed").alias("host_failed"))
    # moments of the hosts' rates around the overall rate: the spread beyond the binomial's own sets the prior's weight
    s = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("f"),
        F.count("*").alias("k"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("q"),
    ).first()
    n, f, k, q = (float(x or 0) for x in (s.n, s.f, s.k, s.q))
    m = f / n if n else 0.0
    spread = (q - n * m * m) / n - m * (1 - m) * k / n if n else 0.0
    weight = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    rate = (F.col("host_failed") + F.lit(m * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rules' figures, base_failed, the host's verdict and kept, one row per document."""
    scratch = Scratch(docs.sparkSession)
    figures = scratch.keep(rule_figures(docs, id_col, text_col, host_col), "rule-figures")
    rejected = host_verdicts(figures, max_rate).where("host_rejected").select("host", "host_rejected")
    out = join_checked(figures, rejected, "host", "left")
    return out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i+2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM p, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
a AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines AS rule_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (rule_failed) AS f FROM a WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT sum(n) AS n, count(*) AS k, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM h),
v AS (SELECT m, (q - n * m * m) / n - m * (1 - m) * k / n AS spread FROM s),
c AS (SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS wt FROM v),
x AS (SELECT host, (f + m * wt) / (n + wt) > 0.5 AS rejected FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM a LEFT JOIN x USING (host)
"""
