"""Tables of the test data as trees of nodes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.rollup import build_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/region/nation/customer/order, sizes in cents; customers without orders are empty folders."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    folder = F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name", "c_name"))
    customers = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customers.select("c_custkey", folder.alias("folder"))
    leaves = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat_ws("/", "folder", F.col("o_orderkey").cast("string")).alias("full_path"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        F.col("o_orderdate").alias("modified_utc"),
    )
    return build_nodes(leaves, customers.select(F.col("folder").alias("full_path")), "orders")


def documents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/lang/source/doc_id.txt with the text's bytes as content; times are made up from the id."""
    d = table(spark, sf_dir, "documents")
    content = F.col("text").cast("binary")
    seconds = F.lit(1704067200) + (F.col("doc_id") * 7919 % 1000) * 3600
    return d.select(
        "doc_id",
        F.concat(F.lit("/"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("full_path"),
        F.octet_length(F.col("text")).cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(seconds).alias("modified_utc"),
        content.alias("content"),
    )


def deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/lang/source/doc_id.txt, a third of them below a folder for each digit of the id."""
    files = documents_files(spark, sf_dir).drop("content")
    number = F.col("doc_id").cast("string")
    folders = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(number, r"(\d)", "$1/")).otherwise("")
    return files.withColumn("full_path", F.concat(P.parent_of(F.col("full_path")), F.lit("/"), folders, number, F.lit(".txt")))


def documents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_nodes(documents_files(spark, sf_dir).drop("content"), None, "documents")


def moved_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents tree: some files moved, renamed, removed, changed and added."""
    files = documents_files(spark, sf_dir).drop("content")
    k = lambda m, r: F.col("doc_id") % m == r
    parts = F.split("full_path", "/")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    new_path = (
        F.when(k(11, 3), F.concat(F.lit("/archive/"), F.get(parts, F.lit(2)), F.lit("/"), name))
        .when(k(13, 5), F.concat(F.lit("/"), F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.concat(F.lit("renamed_"), name))))
        .otherwise(F.col("full_path"))
    )
    current = files.where(~k(17, 7)).select(
        "doc_id", new_path.alias("full_path"), (F.col("size_bytes") + F.when(k(19, 2), 10).otherwise(0)).cast("bigint").alias("size_bytes"), "modified_utc"
    )
    added = files.where(k(23, 1)).select("doc_id", F.concat(F.lit("/new/extra_"), name).alias("full_path"), (F.col("doc_id") + 1).alias("size_bytes"), "modified_utc")
    return build_nodes(files, None, "before"), build_nodes(current.unionByName(added), None, "after")


def pages_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/host/path/page-id.html: folders as deep as the url, sizes in bytes of html."""
    url = F.regexp_replace("url", r"^[^:]*://|[?#].*$", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(url, r"/+$", ""))
    leaves = table(spark, sf_dir, "pages").select(
        F.concat(folder, F.lit("/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("full_path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("modified_utc"),
    )
    return build_nodes(leaves, None, "pages")


#: The two times at which events are counted.
EVENT_CUTS = ("2024-01-15 00:00:00", "2024-01-25 00:00:00")


def events_tree(spark: SparkSession, sf_dir: str, cut: str) -> DataFrame:
    """/user/event type, sized by the number of events before a time; at the second cut every seventh user is gone, and
    every eleventh one's types have new names."""
    e, kind = table(spark, sf_dir, "events").where(F.col("ts") < F.lit(cut).cast("timestamp")), F.col("event_type")
    if cut == EVENT_CUTS[1]:
        e = e.where("user_id % 7 <> 3")
        kind = F.when(F.col("user_id") % 11 == 5, F.concat(kind, F.lit("_new"))).otherwise(kind)
    path = F.concat(F.lit("/user_"), F.col("user_id").cast("string"), F.lit("/"), kind)
    leaves = e.groupBy(path.alias("full_path")).agg(F.count("*").alias("size_bytes"), F.max("ts").alias("modified_utc"))
    return build_nodes(leaves, None, cut)


def embedding_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per vector: a bit for each positive component, in order from the lowest. Of every fourth vector there is
    a copy whose hash differs in as many bits as its id leaves by 14."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(False).alias("copy"))
    vectors = vectors.union(vectors.where("vec_id % 4 = 0").withColumn("copy", F.lit(True)))
    flipped = lambda i: F.col("copy") & ((i * 7 + F.col("vec_id")) % 64 < F.col("vec_id") % 14)
    none = F.lit(0).cast("bigint")
    bit = lambda i: F.when((F.get("embedding", F.lit(i)) > 0) != flipped(F.lit(i)), F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(none)
    bits = F.when(F.col("embedding").isNotNull(), functools.reduce(lambda h, b: h.bitwiseOR(b), map(bit, range(64))))
    return vectors.select(
        F.concat(F.lit("/img/"), F.when(F.col("copy"), "copy_").otherwise(""), F.col("vec_id").cast("string"), F.lit(".png")).alias("full_path"),
        (F.lit(1000) + F.col("vec_id") % 97).cast("bigint").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 37 % 501 * 60).alias("modified_utc"),
        bits.alias("hash"),
    )


def conversations_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/conv_id/turn "role" {}.txt, names with marks that formats must escape; sizes are the texts' bytes, times follow the turns."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("turn \\"), F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.lit(' "'), F.coalesce("role", F.lit("-")), F.lit('" {"Name":{}.txt'))
    path = F.concat(F.lit("/"), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit("/"), name)
    files = c.select(path.alias("full_path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size_bytes"), F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("modified_utc"))
    return build_nodes(files.groupBy("full_path").agg(F.sum("size_bytes").alias("size_bytes"), F.max("modified_utc").alias("modified_utc")), None, "conversations")
