"""The corpus pipeline: stages over the documents table, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents.

Defined cases: texts that are null, empty or without a letter go at the first stage. A null doc_id is no duplicate of
anything and stays. Equal rows of one id stay or go together; of rows of one id with different texts each is judged by
its own text. Of documents that are tied as duplicates the smallest id stays. Texts may be of any length and every stage
reads them whole. Empty tables give empty tables. Extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import op3_minhash_dedup, op4_decontamination, op7_language_id, op8_byte_bpe, op10_substring_dedup
from arborlake.llm.common import ID_ROWS, Scratch, fresh, join_checked, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    found = op7_language_id.identify(docs, carry=docs.columns)
    return found.where("lang_pred <> 'und'").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    gone_id, gone_mark = fresh(docs, "gone_id", "gone_mark")
    gone = op3_minhash_dedup.near_duplicates(docs, marked=True).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    return join_checked(docs, gone, (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_mark)), "left_anti", ID_ROWS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier document's; n_chars follows the text."""
    _, found = op10_substring_dedup.repeated_passages(docs)
    out = op10_substring_dedup.cut(docs, found)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = op4_decontamination.contaminated_spans(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return op4_decontamination.judged(found).where(~F.col("contaminated")).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers as p

    both = op8_byte_bpe.encode(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, decode_too=True)
    return op8_byte_bpe.digests(both)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Stages train models and verify hashed candidates, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
