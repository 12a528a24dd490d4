"""Images as a table: decoded by the tasks' JVM, hashed as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dhash import pixel_hash
from ..plans.workers import can_import
from ..schema import IMAGE_EXTENSIONS, fold


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """origin and hash of every image below a folder, by its extension; the hash is null if it cannot be decoded.

    PNG, JPEG, BMP and GIF (the first picture) are read by Spark's own image source, without any Python library; other
    types have no hash. An image is one row, as decoding needs all of it.
    """
    can_import(spark)
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    extension = fold(F.regexp_extract("origin", r"(\.[^./]+)$", 1))
    return rows.where(extension.isin(IMAGE_EXTENSIONS)).select("origin", pixel_hash("height", "width", "nChannels", "data").alias("hash"))
