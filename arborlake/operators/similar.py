"""Similar images: pairs of perceptual hashes within a Hamming distance, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import HOT_ROWS, rank_within
from ..plans.scratch import Scratch
from ..plans.workers import ready
from ..schema import IMAGE_EXTENSIONS, fold, sort_fold
from .components import components

#: The default distance, and the default number of images that are looked at.
DISTANCE, MOST_IMAGES = 10, 8_000
#: Up to these distances many hashes are joined by equal bands, and by bands of 16 bits that differ in two at the most.
BANDED, PROBED = 8, 11
#: So many hashes are few, and so many of a band are compared under one key.
FEW, BLOCK = 250_000, 2_000
#: If all hashes are one bucket, so many are a block; a shard of so many is linked in memory.
WIDE_BLOCK, SHARD = 8_000, 2_000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def image_files(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("is_directory") & (F.col("size_bytes") > 0) & fold(F.col("extension")).isin(IMAGE_EXTENSIONS))


def newest(images: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """The latest images, ties by path."""
    return images.orderBy(F.desc_nulls_last("modified_utc"), "full_path").limit(most)


def cap_figures(images: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """One row: images found, looked at, and whether some were left out."""
    found = images.agg(F.count("*").alias("found"))
    return found.select("found", F.least("found", F.lit(most).cast("bigint")).alias("considered"), (F.col("found") > most).alias("truncated"))


def hash_pairs(hashes: DataFrame, distance: int = DISTANCE, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(a, b) of distinct hashes, a < b, within the distance. hashes: hash.

    Hashes meet in buckets: of equal bands up to a distance of 8, of bands that differ in two bits at the most up to 11.
    Beyond that no band tells much, and all hashes are one bucket, as they are when there are few. A bucket of more than
    `block` hashes is split by their hash values into blocks, and each pair of its blocks is a key of its own, so every
    comparison is made under a bounded key, whatever the distance and however hot a band is: of bands in an equi-join,
    of the one bucket (in blocks four times as large) by arrays.
    """
    if not 0 <= distance <= 64:
        raise ValueError("the distance is between 0 and 64")
    own = hashes.select("hash").where("hash IS NOT NULL").distinct()
    if distance > PROBED or own.limit(few + 1).count() <= few:
        return _bucket_pairs(own, distance, 4 * block).select("a", "b")
    one = own.select(F.col("hash").alias("a"))
    if distance <= BANDED:
        # hashes within t bits agree on one of t + 1 bands at least
        n = distance + 1
        edges = [64 * k // n for k in range(n + 1)]
        bands = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.shiftleft("a", 64 - hi), 64 - hi + lo).alias("v")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))))
        return _within(one.select("a", F.explode(bands).alias("band")), distance, block).distinct()
    # hashes within 11 bits differ in two at the most on one of four bands; each side takes one bit of them
    flips = F.array(*(F.lit(x).cast("bigint") for x in (0, *(1 << i for i in range(16)))))
    bands = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("a", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("v")) for k in range(4)))
    rows = one.select("a", F.inline(bands)).select("a", "k", F.explode(flips).alias("flip"), "v")
    return _within(rows.select("a", F.struct("k", F.col("v").bitwiseXOR(F.col("flip")).alias("v")).alias("band")), distance, block).distinct()


def _dealt(blocks: int, seed: int = 64) -> Column:
    return F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(blocks)).cast("int")


def _close(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and in b of what is within the distance, some rows of a at a time; each pair once if both are the same."""
    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        first = at if same else 0
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, first:]) <= distance
        x, y = np.divmod(np.flatnonzero(near), len(b) - first)
        x, y = x + at, y + first
        yield (x[x < y], y[x < y]) if same else (x, y)


def _met(rows: DataFrame, inner: int, blocks: int, compare: Callable, schema: str) -> DataFrame:
    """compare(table of the one, table of the other, whether both are one) for each pair of blocks of which the first
    is below `inner`. rows: own (a block below `blocks`) and what compare needs."""
    met = F.when(F.col("own") < inner, blocks).otherwise(inner)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), met - 1)).alias("x"))
    rows = rows.select(F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), *(c for c in rows.columns if c != "x"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j = (x.as_py() for x in key)
        own = table["own"].to_numpy()
        for out in compare(*(table.take(pa.array(np.flatnonzero(own == k))).combine_chunks() for k in (i, j)), i == j):
            yield from out.to_batches()

    keys = inner * blocks - inner * (inner - 1) // 2
    return ready(rows).repartition(min(keys, 1_000), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


def _bits(table: pa.Table) -> np.ndarray:
    return table["hash"].to_numpy().view(np.uint64)


def _bucket_pairs(rows: DataFrame, distance: int, block: int = WIDE_BLOCK) -> DataFrame:
    """(a, b, distance, name_a, name_b) of hashes a < b within the distance, each pair of blocks compared by arrays.
    rows: hash, each once, and maybe name."""
    rows = rows if "name" in rows.columns else rows.withColumn("name", F.lit(None).cast("string"))
    blocks = -(-rows.count() // block) or 1

    def compare(one, other, same):
        a, b = _bits(one), _bits(other)
        for x, y in _close(a, b, distance, same):
            turned = a[x].view(np.int64) > b[y].view(np.int64)
            d = np.bitwise_count(a[x] ^ b[y]).astype(np.int32)
            p, q = one["name"].take(pa.array(x)), other["name"].take(pa.array(y))
            ab = [np.where(turned, b[y], a[x]).view(np.int64), np.where(turned, a[x], b[y]).view(np.int64)]
            names = [pa.compute.if_else(turned, q, p), pa.compute.if_else(turned, p, q)]
            yield pa.table([pa.array(ab[0]), pa.array(ab[1]), pa.array(d), *names], ["a", "b", "distance", "name_a", "name_b"])

    return _met(rows.select("hash", "name", _dealt(blocks).alias("own")), blocks, blocks, compare, "a bigint, b bigint, distance int, name_a string, name_b string")


def _shard_links(own: DataFrame, distance: int, shards: int, seed: int) -> DataFrame:
    """(a, b): within each shard, the first hash of a component and every other one of it."""

    def link(table: pa.Table) -> pa.Table:
        h = np.sort(table["hash"].to_numpy()).view(np.uint64)
        left, a, b = np.ones(len(h), bool), [], []
        for first in range(len(h)):
            if not left[first]:
                continue
            left[first], front = False, np.array([first])
            while front.size:
                near = np.zeros(len(h), bool)
                for at in range(0, len(front), 256):
                    near |= (np.bitwise_count(h[front[at : at + 256], None] ^ h[None, :]) <= distance).any(0)
                front = np.flatnonzero(near & left)
                left[front] = False
                a.append(np.full(len(front), first)), b.append(front)
        places = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        return pa.table([pa.array(h[x].view(np.int64)) for x in places], ["a", "b"])

    return ready(own.select("hash", _dealt(shards, seed).alias("shard"))).groupBy("shard").applyInArrow(link, "a bigint, b bigint")


def hash_groups(hashes: DataFrame, distance: int = DISTANCE, scratch: Scratch | None = None, few: int = FEW, block: int = WIDE_BLOCK, shard: int = SHARD) -> DataFrame:
    """(id, component) of the hashes that chain with others within the distance, as components of hash_pairs has them.

    Components need no more pairs than hold them together. Hashes are dealt into shards twice, and each shard is linked
    in memory, which leaves most in one component if the distance is wide. A link that is still missing leads from one
    component to another, so one of its ends is outside of the largest: what is outside is compared with all.
    Nothing is lost if no component is large, but then the comparisons grow with the square of the hashes.
    """
    if not 0 <= distance <= 64:
        raise ValueError("the distance is between 0 and 64")
    scratch = scratch or Scratch(hashes.sparkSession)
    own = scratch.keep(hashes.select("hash").where("hash IS NOT NULL").distinct(), "hashes")
    n = own.count()
    if distance <= PROBED and n > few:
        return components(hash_pairs(own, distance, few), scratch)
    shards = -(-n // shard) or 1
    links = _shard_links(own, distance, shards, 1)
    if shards == 1:
        return components(links, scratch)
    found = components(links.union(_shard_links(own, distance, shards, 2)), scratch)
    named = own.join(found.withColumnRenamed("id", "hash"), "hash", "left").select("hash", F.coalesce("component", "hash").alias("component"))
    named = scratch.keep(named, "named")
    largest = named.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    rest = n - largest["count"]
    if not rest:
        return found
    inner, outer = -(-rest // block), -(-largest["count"] // block)
    place = F.when(F.col("component") == largest["component"], _dealt(outer) + inner).otherwise(_dealt(inner))

    def compare(one, other, same):
        c, d = one["component"].to_numpy(), other["component"].to_numpy()
        for x, y in _close(_bits(one), _bits(other), distance, same):
            ends = np.unique(np.stack([c[x], d[y]], 1)[c[x] != d[y]], axis=0)
            yield pa.table([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    joined = components(_met(named.select("hash", "component", place.alias("own")), inner, inner + outer, compare, "a bigint, b bigint"), scratch)
    out = named.join(joined.select(F.col("id").alias("component"), F.col("component").alias("wider")), "component", "left")
    out = out.select(F.col("hash").alias("id"), F.coalesce("wider", "component").alias("component"))
    return out.join(out.groupBy("component").count().where("count > 1"), "component", "left_semi").select("id", "component")


def _within(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """The pairs (a, b) of the same band within the distance. rows: a, band.

    The joins are merges by hint: rows come of an explode, which Spark takes for as small as what goes in, and it would
    broadcast them all.
    """
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return _across_blocks(rows.hint("merge").join(sizes.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "band"), ["band"], distance)


def _across_blocks(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """The pairs of equal keys within the distance; a pair of blocks i <= j is the key of the rows of block i on one side
    and of block j on the other. rows: a, blocks and the keys."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a", F.lit(64)), F.col("blocks")).cast("int"))
    left = rows.select(*keys, "a", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = rows.select(*keys, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    order = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    both = left.hint("merge").join(right, [*keys, "i", "j"]).where((F.col("a") != F.col("b")) & order & (hamming(F.col("a"), F.col("b")) <= distance))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def representatives(images: DataFrame) -> DataFrame:
    """full_path, hash and representative: the first path of each hash."""
    some = images.where("hash IS NOT NULL")
    return some.join(some.groupBy("hash").agg(F.min("full_path").alias("representative")), "hash").select("full_path", "hash", "representative")


def image_pairs(images: DataFrame, distance: int = DISTANCE, few: int = FEW) -> DataFrame:
    """(a, b, distance) of the representatives of different hashes within the distance, by path."""
    names = images.where("hash IS NOT NULL").groupBy("hash").agg(F.min("full_path").alias("name"))
    names = Scratch(images.sparkSession).keep(names, "names")
    if distance > PROBED or names.count() <= few:  # the names go along with the hashes
        out = _bucket_pairs(names, distance)
    else:
        side = lambda x: names.select(F.col("hash").alias(x), F.col("name").alias(f"name_{x}"))
        out = hash_pairs(names, distance, few).join(side("a"), "a").join(side("b"), "b").withColumn("distance", hamming(F.col("a"), F.col("b")))
    return out.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "distance")


def similar_groups(images: DataFrame, distance: int = DISTANCE, scratch: Scratch | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """full_path, size_bytes, hash, group_id (the least hash) and rank of every image in a group of two or more.

    Groups chain: members need not be within the distance of each other. The largest image, then the
    first path in any case, has rank 1.
    """
    scratch = scratch or Scratch(images.sparkSession)
    images = scratch.keep(images.select("full_path", "size_bytes", "hash"), "images")
    linked = hash_groups(images, distance, scratch)
    named = images.where("hash IS NOT NULL").join(linked.select(F.col("id").alias("hash"), "component"), "hash", "left")
    named = named.select("full_path", "size_bytes", "hash", F.coalesce("component", "hash").alias("group_id"))
    named = scratch.keep(named, "named")
    counted = named.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    order = [F.desc("size_bytes"), sort_fold(F.col("full_path")), F.col("full_path")]
    return rank_within(named.join(counted, "group_id"), ["group_id"], order, hot_rows=hot_rows)


def by_waste() -> list[Column]:
    """The order of groups (the rows of group_waste): the most waste first, ties by the kept path."""
    return [F.desc("wasted_bytes"), F.col("kept_path")]


def group_waste(groups: DataFrame) -> DataFrame:
    """One row per group: members, and the bytes of all but the largest."""
    return groups.groupBy("group_id").agg(F.count("*").alias("members"), (F.sum("size_bytes") - F.max("size_bytes")).alias("wasted_bytes"), F.max(F.when(F.col("rank") == 1, F.col("full_path"))).alias("kept_path"))
