"""A Merkle manifest of a dataset: a digest for each document, a tree over each group, one root, and proofs.

Ranks come from histograms of digits, without a global sort. Ids are counted by (group, id >> 12), these counts by
the next 12 bits, and so on until one prefix is left; the sums of smaller siblings, added from the top down, say
how many ids of the group come before a prefix, and within one prefix of the last 4,096 ids a window numbers them.
If one prefix holds more rows than a task should number (ids repeated at will, or null), equal rows are counted
first and the digits of the leaf's digest follow those of the id.

A rank's digits in base 8 are the leaf's key in the trie. Nodes are reduced longest prefix first: four digits at
a time, so that 4,096 nodes that share all but their last four digits meet in one row, a tile, which becomes one
node of the next round. Proofs go down the same way: a tile's own siblings in front of those of the tile above.
No row holds more than a tile, and the number of rounds is the logarithm of the largest group to the base 4,096.

Defined cases: a null value is hashed as `-`; a null group comes first, an empty one next; rows of one id are
ordered by their leaf's digest, null ids come first; repeated rows are leaves as often as they come; texts may be
of any length and are read whole; the folded root of a row that is not tampered with is folded from its own leaf;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import number_rows
from .chunks import text_chunks
from .common import BROADCAST_ROWS, Scratch, join_checked, small_batches, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, the bits of a rank's digit, and levels of a tile.
FANOUT, DIGIT, LEVELS = 8, 3, 4
#: Bits of a digit of an id, and the most rows that one prefix of all but the last digit may hold.
DIGIT_BITS, MOST_ROWS = 12, 1 << 16


def digest(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def tampered(doc_id: str | None, text: bytes) -> bytes | None:
    """The text after tampering, which comes over every third id by its crc32; else None."""
    return text.lower() if doc_id is not None and zlib.crc32(doc_id.encode()) % 3 == 0 else None


def leaves(docs: DataFrame, fields=FIELDS, group: str = "lang", tamper=tampered) -> DataFrame:
    """doc_id, part (the group as text that sorts like it, null first), leaf, and altered: the leaf after
    tampering, null where there is none. The first of the fields is the id, the last the text."""
    kind = docs.schema[fields[0]].dataType.simpleString()
    part = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))
    slim = docs.select(F.col(fields[0]).alias("doc_id"), part.alias("part"), *(F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(fields)))
    last = f"f{len(fields) - 1}"

    def run(batches):
        frame = lambda v: b"-" if v is None else b"%d:%b" % (len(v), v)
        for batch, texts in text_chunks(batches, last):
            head = [batch.column(2 + k).cast(pa.large_binary()).to_pylist() for k in range(len(fields) - 1)]
            whole, other = [], []
            for row in zip(*head, texts):
                front, text = b"".join(map(frame, row[:-1])), row[-1]
                whole.append(hashlib.sha256(front + frame(text)).digest())
                after = tamper(None if row[0] is None else row[0].decode(), text or b"")
                other.append(None if after is None else whole[-1] if text is None or after == text else hashlib.sha256(front + frame(after)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(other, pa.binary())], ["doc_id", "part", "leaf", "altered"])

    return small_batches(slim).mapInArrow(run, f"doc_id {kind}, part string, leaf binary, altered binary")


def rows_before(cells: DataFrame, group: list[str], value: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(group, value, before): how many rows of the group have a smaller value; and (group, n): its rows.

    cells: group (no nulls), value (bigint) and n, each value of a group once. Levels of digit histograms, the
    finest first; each node of a level has at most 2^12 children.
    """
    now = scratch.keep(cells.select(*group, F.col(value).alias("p"), "n"), "digits")
    low, high = now.agg(F.min("p"), F.max("p")).first()
    levels, ups = [now], []
    while low != high:
        signs = (low, high) == (-1, 0)  # shifts end here: the two signs are the last digit
        ups.append(F.lit(0).cast("bigint") if signs else F.shiftright("p", DIGIT_BITS))
        low, high = (0, 0) if signs else (low >> DIGIT_BITS, high >> DIGIT_BITS)
        levels.append(scratch.keep(levels[-1].groupBy(*group, ups[-1].alias("p")).agg(F.sum("n").alias("n")), "digits"))
    sizes = levels[-1].select(*group, "n")
    before = levels[-1].select(*group, "p", F.lit(0).cast("bigint").alias("before"))
    for level, up in zip(reversed(levels[:-1]), reversed(ups)):
        smaller = W.partitionBy(*group, "up").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumn("up", up).withColumn("inside", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        above = before.select(*group, F.col("p").alias("up"), "before")
        before = scratch.keep(level.join(above, [*group, "up"]).select(*group, "p", (F.col("before") + F.col("inside")).alias("before")), "before")
    return before.withColumnRenamed("p", value), sizes


def ranked(rows: DataFrame, scratch: Scratch, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows with idx, their place in the order of their part by id and leaf, from 0; and (part, n).

    rows: doc_id (any whole number), part, leaf, altered. They are read twice, so give a written table.
    """
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("n", F.lit(1).cast("bigint"))
    rows = rows.withColumn("bucket", F.shiftright("id", DIGIT_BITS))
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"))
    buckets = scratch.keep(count(rows, "part", "bucket"), "buckets")
    before, sizes = rows_before(buckets, ["part"], "bucket", scratch)
    keys = ["part", "bucket"]
    if not buckets.where(F.col("n") > most_rows).isEmpty():
        rows = scratch.keep(count(rows, "doc_id", "id", "part", "bucket", "leaf", "altered"), "counted")
        before, _ = rows_before(count(rows, "part", "id"), ["part"], "id", scratch)
        rows = rows.withColumn("head", F.conv(F.substring(F.hex("leaf"), 1, 6), 16, 10).cast("bigint"))
        inside, _ = rows_before(count(rows, "part", "id", "head"), ["part", "id"], "head", scratch)
        before = inside.withColumnRenamed("before", "inside").join(before, ["part", "id"]).select("part", "id", "head", (F.col("before") + F.col("inside")).alias("before"))
        keys = ["part", "id", "head"]
    smaller = W.partitionBy(*keys).orderBy("id", "leaf").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    first = F.col("before") + F.col("inside")
    placed = join_checked(rows, before, keys, "inner").select("doc_id", "part", "leaf", "altered", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("idx"))
    return placed, sizes


def _levels(nodes: list[str], more: bool, depth: int) -> list[list[str]]:
    """The nodes of a tile level by level. more: other tiles of the part exist, so all `depth` levels count."""
    out = [nodes]
    while len(out) <= depth if more else len(out[-1]) > 1:
        now = out[-1]
        out.append([digest("".join(now[i : i + FANOUT])) for i in range(0, len(now), FANOUT)])
    return out


def _siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands to the left and to the right of a node in its run, level by level."""
    left, right = [], []
    for now in levels[:-1]:
        i = at // FANOUT * FANOUT
        left.append("".join(now[i:at]))
        right.append("".join(now[at + 1 : i + FANOUT]))
        at //= FANOUT
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that follows from a node and its siblings."""
    for a, b in zip(left, right):
        node = digest(a + node + b)
    return node


def _tiles(nodes: DataFrame, sizes: DataFrame, payload: tuple[str, ...], depth: int) -> DataFrame:
    """part, tile, more (whether the part has other tiles) and node with the payload: lists of at most 8^depth, in order."""
    tiled = nodes.groupBy("part", F.shiftright("idx", depth * DIGIT).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("idx", "node", *payload))).alias("rows"))
    tiled = join_checked(tiled, sizes, "part", "inner")
    return tiled.select("part", "tile", (F.col("n") > FANOUT**depth).alias("more"), *(F.col(f"rows.{c}").alias(c) for c in ("node", *payload)))


def climb(nodes: DataFrame, sizes: DataFrame, scratch: Scratch, payload: tuple[str, ...] = (), depth: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The tiles of each round, and (part, node): the roots. nodes: part, idx from 0, node (binary) and the payload, which stays in the first round's tiles."""

    def up(batches):
        for batch in batches:
            roots = [_levels([x.hex() for x in nodes], more, depth)[-1][0] for more, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes.fromhex(r) for r in roots], pa.binary())], ["part", "idx", "node"])

    rounds = []
    while True:
        tiles = scratch.keep(_tiles(nodes, sizes, payload, depth), "tiles")
        rounds.append(tiles)
        nodes = scratch.keep(small_batches(tiles.select("part", "tile", "more", "node")).mapInArrow(up, "part string, idx bigint, node binary"), "nodes")
        payload = ()
        if tiles.where("more").isEmpty():
            return rounds, nodes.select("part", "node")
        sizes = sizes.select("part", F.ceil(F.col("n") / FANOUT**depth).cast("bigint").alias("n"))


def node_paths(tiles: DataFrame, depth: int = LEVELS) -> DataFrame:
    """part, idx, lefts and rights of every node of these tiles. tiles: with lefts and rights, what is above each."""

    def down(batches):
        for batch in batches:
            for part, tile, more, nodes, lefts, rights in zip(*(c.to_pylist() for c in batch.columns)):
                levels, n = _levels([x.hex() for x in nodes], more, depth), len(nodes)
                paths = [_siblings(levels, i) for i in range(n)]
                lists = [pa.array([p[side] + above for p in paths], pa.list_(pa.string())) for side, above in enumerate((lefts, rights))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array([tile * FANOUT**depth + i for i in range(n)], pa.int64()), *lists], ["part", "idx", "lefts", "rights"])

    slim = tiles.select("part", "tile", "more", "node", "lefts", "rights")
    return small_batches(slim).mapInArrow(down, "part string, idx bigint, lefts array<string>, rights array<string>")


def descend(rounds: list[DataFrame], tops: DataFrame, scratch: Scratch, depth: int = LEVELS) -> DataFrame:
    """The tiles of the first round with lefts and rights, the siblings above each of them, level by level.

    tops: part, idx (0), and the lefts and rights above each part's root.
    """
    for tiles in reversed(rounds[1:]):
        tops = scratch.keep(node_paths(tiles.join(tops.withColumnRenamed("idx", "tile"), ["part", "tile"]), depth), "paths")
    return rounds[0].join(tops.withColumnRenamed("idx", "tile"), ["part", "tile"])


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", tamper=tampered, scratch: Scratch | None = None, depth: int = LEVELS, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per document."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kind = docs.schema[fields[0]].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = scratch.keep(leaves(docs, fields, group, tamper), "leaves")
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    placed, sizes = ranked(rows, scratch, most_rows)
    sizes = scratch.keep(sizes, "sizes")
    rounds, subroots = climb(placed.withColumnRenamed("leaf", "node"), sizes, scratch, ("doc_id", "altered"), depth)

    # the parts' roots are the leaves of one more tree, in the order of the parts
    named = scratch.keep(number_rows(subroots, F.col("part")).select("part", "node", (F.col("nth") - 1).alias("idx")), "subroots")
    one, none = F.lit("").alias("part"), F.expr("cast(array() AS array<string>)")
    upper, top = climb(named.select(one, "idx", "node"), named.groupBy(one).agg(F.count("*").alias("n")), scratch, depth=depth)
    root = bytes(top.first()["node"]).hex()
    start = spark.range(1).select(one, F.col("id").alias("idx"), none.alias("lefts"), none.alias("rights"))
    over = node_paths(descend(upper, start, scratch, depth), depth).drop("part")
    tops = scratch.keep(named.join(over, "idx").select("part", F.lit(0).cast("bigint").alias("idx"), F.lower(F.hex("node")).alias("subroot"), "lefts", "rights"), "tops")
    tiles = join_checked(descend(rounds, tops.drop("subroot"), scratch, depth), tops.select("part", "subroot"), "part", "inner")

    def prove(batches):
        for batch in batches:
            ids = batch.column(0)
            for k, (more, nodes, altered, lefts, rights, subroot) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                own = [x.hex() for x in nodes]
                levels, proofs, folded = _levels(own, more, depth), [], []
                for i, node in enumerate(own):
                    left, right = _siblings(levels, i)
                    left, right = left + lefts, right + rights
                    proofs.append(digest("".join(a + b for a, b in zip(left, right))))
                    folded.append(fold(node if altered[i] is None else altered[i].hex(), left, right))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [ids[k].values, pa.array(own), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return small_batches(tiles.select("doc_id", "more", "node", "altered", "lefts", "rights", "subroot")).mapInArrow(prove, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def sql(levels: int = 7, upper: int = 3) -> str:
    """The SQL of the query, for groups of up to 8^levels rows and up to 8^upper groups."""
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda t: f"sha256({' || '.join(map(text, (*FIELDS[:-1], t)))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(8), lambda j: ((ascii((doc_id::VARCHAR)[i]) >> j) & 1)::BIGINT)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295)"
    out = [
        f"a0 AS (SELECT doc_id, coalesce('=' || lang, '') AS part, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents)",
        "b0 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM a0)",
        "n0 AS (SELECT part, idx AS i, h, count(*) OVER (PARTITION BY part) AS n FROM b0)",
        "p0 AS (SELECT b0.*, idx AS i, '' AS proof, f AS folded FROM b0)",
    ]

    def level(k: int) -> None:
        """Nodes n and, for each leaf, its proof and folded digest p of level k from those below; a lone node stays."""
        out.append(f"n{k} AS (SELECT part, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CASE WHEN any_value(n) % 8 = 0 THEN any_value(n) // 8 ELSE any_value(n) // 8 + 1 END AS n FROM n{k - 1} GROUP BY part, i // 8)")
        out.append(f"s{k} AS (SELECT x.part, x.i, any_value(x.n) AS n, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r FROM n{k - 1} x JOIN n{k - 1} y ON x.part = y.part AND x.i // 8 = y.i // 8 GROUP BY x.part, x.i)")
        out.append(f"p{k} AS (SELECT p.* REPLACE (p.i // 8 AS i, proof || l || r AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded) FROM p{k - 1} p JOIN s{k} s ON p.part = s.part AND p.i = s.i)")

    for k in range(1, levels + 1):
        level(k)
    k = levels + 1
    out.append(f"u AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS i FROM n{levels})")
    out.append(f"n{k} AS (SELECT '' AS part, i, subroot AS h, count(*) OVER () AS n FROM u)")
    out.append(f"p{k} AS (SELECT p.* REPLACE ('' AS part, u.i AS i), subroot FROM p{levels} p JOIN u ON p.part = u.part)")
    for k in range(k + 1, k + 1 + upper):
        level(k)
    return f"WITH {', '.join(out)} SELECT doc_id, h AS leaf, subroot, (SELECT h FROM n{k}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM n{k}) AS verified FROM p{k} p"
