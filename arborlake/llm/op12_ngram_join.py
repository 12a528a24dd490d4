"""N-gram Jaccard join: set-similarity self-join by prefixes under several global orders.

A global order of all shingles is fixed; two sets of n shingles that are similar enough share one of their first
n - ceil(s n) + 1. That holds under any order, so a pair must share a prefix token under every one of ORDERS orders.
The first order puts frequent shingles last, by a table of CELLS counters over all documents that shingles hash
into, of fixed size at any scale; it makes the candidates, in an equi-join on prefix tokens, within bounds of size
and place. The other orders are of unrelated hashes; a candidate that shares no prefix token under each of them is
dropped before any text is fetched. What is left is confirmed on full sets.

Equal sets are collapsed first, by a 128-bit hash; a 64-bit one of that names them from there on, under the first
seed that gives no two sets one name. The classes of linked sets then take three rounds, whatever the buckets hold:
(1) in each bucket all sets are held against a hub, the one with the fewest rarer shingles, which of a group of
edited copies is the one nearest its middle, so the group is a star; (2) in buckets that still hold several classes,
against the hub of those outside the largest class; (3) in those that still do, every set outside the largest class is held against all
others of other classes. A bucket whose shingle the table shows to be no frequent one is bounded, and is dealt to a
task as it is; rows of frequent shingles are added up before they are shuffled, and joined. In round 3 a bucket's sets are cut into slices by hash, and each of these meets each slice
in a task of its own, so a hot bucket is many tasks; only pairs within the bounds leave the join. The bounds also
say that of a pair one set is light (its place is small against its size), so a bucket without a light set has no
pair left. Nothing is capped or sampled.

Defined cases: a null or empty text has an empty set and is linked with nothing; rows with a null id are linked with
nothing and their class is null; rows of one id are judged each by its own text; the least id names a class, so
there are no ties; texts may be of any length and are read whole; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .chunks import NOT_SPACE, mix, shingles, text_chunks, word_hashes
from .common import Scratch, join_checked, only, small_batches, table

SHINGLE, SIMILARITY = 4, 85
#: Counters of the frequency table, and how many of them make a row of it.
CELLS, BLOCK = 1 << 20, 1 << 14
#: Global orders: one by frequency, the others by hash.
ORDERS = 3
#: A shingle is frequent if its cell counts more than this and than so many times the mean.
FREQUENT, TIMES = 10_000, 4
#: Names of sets that a task recalls, to give copies once.
RECALLED = 100_000
#: Rows of a bucket that meet a set of it in one task.
SLICE = 2_000
#: Up to so many pairs of numbers are broadcast.
LABELS = 200_000

_rng = np.random.Generator(np.random.PCG64(12))
_XOR = _rng.integers(0, 2**63, ORDERS, dtype=np.uint64)


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each, the text of each, and where each text's begin."""
    sh, at = shingles(*word_hashes(texts, NOT_SPACE), width)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((sh, owner))
    sh = sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    sh, owner = sh[new], owner[new]
    return sh, owner, np.searchsorted(owner, np.arange(len(texts) + 1))


def _names(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for each set; of empty sets zeros."""
    n = np.diff(at)
    out = np.zeros((len(n), 2), np.uint64)
    some = n > 0
    if some.any():
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            out[some, k] = mix(np.add.reduceat(mix(sh ^ np.uint64(seed)), at[:-1][some]) + n[some].astype(np.uint64))
    return out


def _binary(names: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in names], pa.binary())


def sets_and_counts(docs: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name) of each document, name being of its set; and (block, counts) of the frequency table, one row a block.

    docs: doc_id, text. One pass over the texts; a task adds up its own counts before it sends them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        empty = pa.array([], pa.int32()), pa.array([], pa.binary())
        ids = None
        for batch, texts in text_chunks(batches, "text"):
            sh, _, at = _sets(texts, width)
            counts += np.bincount((sh >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            ids, n = batch.column(0), len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at), pa.int64()), _binary(_names(sh, at)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "name", "block", "counts"])
        if ids is not None and counts.any():
            blocks = [b.astype(np.min_scalar_type(b.max())).tobytes() for b in counts.reshape(-1, BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blocks, pa.binary())], ["doc_id", "n", "name", "block", "counts"])

    def add(left: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for c in left.column("counts").to_pylist():
            total += np.frombuffer(c, f"u{len(c) // BLOCK}")  # as wide as its largest count
        return pa.table({"block": left.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    both = small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n bigint, name binary, block int, counts binary")
    both = scratch.keep(both, "sets")
    counts = both.where("block IS NOT NULL").select("block", "counts")
    return both.where("block IS NULL").select("doc_id", "n", "name"), counts.groupBy("block").applyInArrow(add, "block int, counts binary")


def frequency_table(counts: DataFrame) -> tuple[np.ndarray, int]:
    """A byte for each cell, its count on a logarithmic scale, and the byte from which a shingle is frequent. The table
    has CELLS bytes at any scale."""
    out = np.zeros(CELLS, np.uint64)
    for block, c in counts.collect():  # CELLS / BLOCK rows
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(c), np.uint64)
    scale = lambda c: np.minimum(np.log2(c + 1.0) * 6, 255).astype(np.uint8)
    return scale(out), int(scale(max(FREQUENT, TIMES * out.mean())))


def prefix_length(n, similarity: int):
    return n - -(-n * similarity // 100) + 1


def prefixes(docs: DataFrame, frequency: tuple[np.ndarray, int], width: int, similarity: int) -> DataFrame:
    """name, n, tokens (the prefix under the first order, in order), plain (how many of them are no frequent ones; these
    come first) and marks (for each other order, the prefix as 32-bit hashes). A task gives a set once, if it recalls it."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        (cells, limit), recalled = shared.value, set()
        for _, texts in text_chunks(batches, "text"):
            sh, owner, at = _sets(texts, width)
            n, names, rows = np.diff(at), _names(sh, at), []
            for d in np.flatnonzero(n > 0):
                name = names[d].tobytes()
                if name not in recalled:
                    rows.append(d)
                    recalled.add(name)
            if len(recalled) > RECALLED:
                recalled.clear()
            rows = np.array(rows, np.int64)
            first = (np.arange(len(sh)) - at[:-1][owner]) < prefix_length(n, similarity)[owner]
            wanted = np.zeros(len(n), bool)
            wanted[rows] = True
            first &= wanted[owner]
            heads = []
            for k in range(ORDERS):
                key = mix(sh ^ _XOR[k])
                if k == 0:  # frequent cells last, then by hash
                    key = cells[sh >> np.uint64(44)].astype(np.uint64) << np.uint64(56) | key >> np.uint64(8)
                heads.append((sh if k == 0 else key)[np.lexsort((key, owner))][first])
            plain = np.bincount(owner[first], weights=cells[heads[0] >> np.uint64(44)] <= limit, minlength=len(n))[rows]
            edge = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(n))[rows])))
            offsets = pa.array(edge.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(heads[0].astype(np.int64, casting="unsafe")))]
            lists += [pa.ListArray.from_arrays(offsets, pa.array((h >> np.uint64(32)).astype(np.uint32).astype(np.int32, casting="unsafe"))) for h in heads[1:]]
            yield pa.RecordBatch.from_arrays([_binary(names[rows]), pa.array(n[rows], pa.int32()), pa.array(plain.astype(np.int32)), *lists], ["name", "n", "plain", "tokens", *(f"mark{k}" for k in range(1, ORDERS))])

    marks = ", ".join(f"mark{k} array<int>" for k in range(1, ORDERS))
    return small_batches(docs.select("text")).mapInArrow(run, f"name binary, n int, plain int, tokens array<bigint>, {marks}")


def buckets(heads: DataFrame) -> DataFrame:
    """key, id, n and x, and the size of the bucket and its hub (lead, m and y), of all tokens that two sets have. heads: id, n, plain, tokens."""
    rows = heads.select("id", "n", "plain", F.posexplode("tokens").alias("x", "key"))
    one = F.min("x").alias("x")
    plain = rows.where("x < plain").select("key", "id", "n", "x").repartition("key").groupBy("key", "id", "n").agg(one)
    whole = W.partitionBy("key").orderBy("x", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    plain = plain.withColumns({"size": F.count("*").over(whole), "hub": F.first(F.struct("x", "id", "n")).over(whole)}).where("size > 1")
    frequent = rows.where("x >= plain").groupBy("key", "id", "n").agg(one)
    hubs = frequent.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("x", "id", "n")).alias("hub")).where("size > 1")
    both = plain.unionByName(frequent.join(hubs, "key"))
    return both.select("key", "id", "n", "x", "size", F.col("hub.id").alias("lead"), F.col("hub.n").alias("m"), F.col("hub.x").alias("y"))


def _bounded(similarity: int):
    """Whether two rows (n, x) and (m, y) of a bucket can be similar enough: x and y shingles stand before the shared one."""
    n, x, m, y = (F.col(c) for c in "nxmy")
    inter = F.least(n - x, m - y)
    return (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & ((100 + similarity) * inter >= similarity * (n + m))


def intersected(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The candidates (a, b) that share a prefix token under every further order. marks: id and the prefixes."""
    names = [c for c in marks.columns if c != "id"]
    side = lambda s: marks.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}{s}") for c in names))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(functools.reduce(lambda p, q: p & q, (F.arrays_overlap(f"{c}a", f"{c}b") for c in names))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, similarity: int) -> DataFrame:
    """The (a, b) whose full sets are similar enough.

    reps: id, rep and name. The set of an id is that of its document rep; if that has rows with several texts, the name
    tells which. Up to LABELS pairs go to where the texts of b are; texts of a, which are few if a are hubs, follow them.
    """
    side = lambda s: reps.select(F.col("id").alias(s), F.col("rep").alias(f"doc{s}"), F.col("name").alias(f"name{s}"))
    named = pairs.join(side("a"), "a").join(side("b"), "b")
    text = lambda s: docs.select(F.col("doc_id").alias(f"doc{s}"), F.col("text").alias(f"t{s}"))
    both = join_checked(text("b"), named, "docb", "inner", LABELS)
    heads = only(docs, named.select(F.col("doca").alias("doc_id")), LABELS).select(F.col("doc_id").alias("doca"), F.col("text").alias("ta"))
    both = both.join(heads, "doca").select("a", "b", "namea", "nameb", "ta", "tb")

    def run(batches):
        for batch, tb in text_chunks(batches, "tb"):
            ta = batch.column(4).cast(pa.large_binary()).to_pylist()
            where: dict[bytes, int] = {}
            rows = [(where.setdefault(x, len(where)), where.setdefault(y, len(where))) for x, y in zip(ta, tb)]
            sh, _, at = _sets(list(where), width)
            names = [x.tobytes() for x in _names(sh, at)]
            keep = []
            for (x, y), na, nb in zip(rows, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = (at[x + 1] - at[x]) + (at[y + 1] - at[y])
                both = len(np.intersect1d(sh[at[x] : at[x + 1]], sh[at[y] : at[y + 1]], assume_unique=True))
                keep.append(names[x] == na and names[y] == nb and both > 0 and 100 * both >= similarity * (n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return small_batches(both).mapInArrow(run, "a bigint, b bigint").distinct()


class _Join:
    """The rounds over one table of buckets."""

    def __init__(self, rows, heads, docs, reps, width, similarity, scratch):
        self.rows, self.heads, self.docs, self.reps = rows, heads, docs, reps
        self.width, self.similarity, self.scratch = width, similarity, scratch
        self.label = None

    def named(self, rows: DataFrame) -> DataFrame:
        """The rows with the class of each."""
        rows = rows.select("key", "id", "n", "x")
        return join_checked(rows, self.label, "id", "left", LABELS).select("key", "id", "n", "x", F.coalesce("component", "id").alias("label"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs of lead and id, repeated at will, to confirmed links."""
        pairs = self.scratch.keep(pairs.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        marks, ids = self.heads.drop("n", "plain", "tokens", "name"), pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        marks = marks.join(F.broadcast(ids), "id", "left_semi") if ids.limit(LABELS + 1).count() <= LABELS else marks
        marks = marks.groupBy("id").agg(*(F.any_value(c).alias(c) for c in marks.columns if c != "id"))
        both = self.scratch.keep(intersected(pairs, marks), "intersected")
        out = self.scratch.keep(verified(both, self.docs, self.reps, self.width, self.similarity), "links")
        self.scratch.drop(pairs, both)
        return out

    def merge(self, links: DataFrame) -> None:
        edges = links
        if self.label is not None:
            edges = edges.union(self.label.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.label = components(edges, self.scratch)
        self.scratch.drop(links)

    def open_buckets(self) -> DataFrame:
        """The rows of buckets in which some set is not of the hub's class; what is in the others is settled."""
        classes = self.label.select(F.col("id").alias("lead"), F.col("component").alias("major"))
        both = join_checked(join_checked(self.rows, self.label, "id", "left", LABELS), classes, "lead", "left", LABELS)
        other = both.where(F.coalesce("component", "id") != F.coalesce("major", "lead"))
        keys = self.scratch.keep(other.select("key").distinct(), "open")
        return join_checked(self.rows, keys, "key", "left_semi", LABELS)

    def split(self, rows: DataFrame) -> DataFrame:
        """The rows, with label, major (the largest class) and size, of buckets that hold several classes and a light row."""
        named = self.scratch.keep(self.named(rows), "named")
        light = (100 + self.similarity) * F.col("x") <= (100 - self.similarity) * F.col("n")
        parts = named.groupBy("key", "label").agg(F.count("*").alias("rows"), F.max(light).alias("light"))
        split = parts.groupBy("key").agg(F.max(F.struct("rows", "label"))["label"].alias("major"), F.count("*").alias("labels"), F.max("light").alias("light"), F.sum("rows").alias("size"))
        rest = self.scratch.keep(named.join(split.where("labels > 1 AND light").select("key", "major", "size"), "key"), "rest")
        self.scratch.drop(named)
        return rest

    def classes(self) -> DataFrame:
        """(id, component) of all sets that are linked with another."""
        bounded = _bounded(self.similarity)
        self.merge(self.links(self.rows.where((F.col("id") != F.col("lead")) & bounded)))
        rest = self.split(self.open_buckets())
        self.scratch.drop(self.rows)
        if rest.isEmpty():
            return self.label
        hub = rest.where("label <> major").groupBy("key").agg(F.min(F.struct("x", "id", "n", "label")).alias("r"))
        hub = hub.select("key", F.col("r.id").alias("lead"), F.col("r.n").alias("m"), F.col("r.x").alias("y"), F.col("r.label").alias("other"))
        self.merge(self.links(rest.join(hub, "key").where((F.col("label") != F.col("other")) & bounded)))
        last = self.split(rest)
        self.scratch.drop(rest)
        if not last.isEmpty():
            self.merge(self.links(self.across(last)))
        return self.label

    def across(self, rest: DataFrame) -> DataFrame:
        """All pairs within the bounds, of rows outside their bucket's largest class with those of other classes."""
        slices = F.ceil(F.col("size") / SLICE).cast("int")
        minor = rest.where("label <> major").select("key", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("label").alias("other"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        every = rest.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
        return every.join(minor, ["key", "slice"]).where((F.col("label") != F.col("other")) & _bounded(self.similarity)).select("lead", "id")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: int = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of docs."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets, counts = sets_and_counts(docs, width, scratch)
    own = sets.where("n > 0 AND doc_id IS NOT NULL")
    # a document of each set, whose text stands for it
    reps = scratch.keep(own.groupBy("name").agg(F.min("doc_id").alias("rep")), "reps")
    seed = 0
    while not reps.groupBy(F.xxhash64("name", F.lit(seed))).count().where("count > 1").isEmpty():
        seed += 1
    reps = reps.withColumn("id", F.xxhash64("name", F.lit(seed)))
    heads = scratch.keep(prefixes(docs.where("text IS NOT NULL AND doc_id IS NOT NULL"), frequency_table(counts), width, similarity), "prefixes")
    heads = heads.withColumn("id", F.xxhash64("name", F.lit(seed)))
    rows = scratch.keep(buckets(heads), "buckets")
    scratch.drop()

    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    label = _Join(rows, heads, texts, reps, width, similarity, scratch).classes()
    least = join_checked(reps, label, "id", "left", LABELS).select("name", "rep", F.coalesce("component", "id").alias("component"))
    first = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = sets.join(least.join(first, "component").select("name", "component_id"), "name", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, b.y FROM r JOIN b ON r.m = b.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w JOIN (SELECT id, min(m) AS component_id FROM r GROUP BY id) c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
