"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A document's minhashes form two collections of M partial keys of K minhashes each. A table's key is
one partial key of either collection, so 2 * M * K minhashes serve M * M tables. Two documents of
similarity s share a key with probability (1 - (1 - s^K)^M)^2: at s = 0.8, K = 2, M = 9 all but 2 of
10,000 pairs, at 0.85 all but 2 of 100,000.

Equal sets are collapsed first. In each bucket every member is held against the bucket's hub (a star),
the member whose buckets are the largest, which stands nearest the middle of a group of edited copies;
verified pairs are links. The members of buckets that then still hold several components, such as
short documents around one very common line, go through an exact join by their rarest shingles: any
link shares one of the first n - ceil(0.8 n) + 1 shingles in an order that puts frequent ones last. If
x of n and y of m shingles stand before it, the intersection is at most the lesser of n - x and m - y,
and x + y is at most a quarter of it, which rejects pairs by place. It also means that of a pair one row
is light (x at most a ninth of n). In each bucket the rows outside its largest component are held against
the others, a bounded number of pairs a round, until the bucket has one component, no light row, or
every such row has been held. So no group is expanded into all its pairs, and none is capped.

Pairs that only share keys are first held against bounds that a link cannot miss or misses with a
chance below one in a million: the sizes' ratio, and agreement of the minhashes.

Defined cases: a null or empty text has an empty set and is linked with nothing; rows with a null id
are linked with nothing and kept; rows of one id are one document for linking, and each returns;
of tied documents the smallest id is kept; texts may be of any length and are read whole; an empty table gives no rows; only the id and text columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .chunks import NOT_SPACE, mix, shingles, text_chunks, word_hashes
from .common import Scratch, only, small_batches, table

SHINGLE = 4
#: Similarity, as a per cent of intersection to union.
SIMILARITY = 80
#: Minhashes of a partial key, and partial keys of a collection.
K, M = 2, 9
#: In each round a bucket holds about so many pairs of rows together.
ROUND_PAIRS = 1_000_000
#: So many of the most frequent shingles are put last in the order of rarity; any order gives the same links.
FREQUENT = 50_000

_rng = np.random.Generator(np.random.PCG64(3))
_XOR = _rng.integers(0, 2**63, 2 * K * M, dtype=np.uint64)
_MUL = _rng.integers(0, 2**62, 2 * K * M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(similarity: int = SIMILARITY, chance: float = 1e-6) -> int:
    """The agreeing minhashes that a pair of this similarity falls short of with less than this chance."""
    n, p = 2 * K * M, similarity / 100
    total, prob = 0.0, (1 - p) ** n
    for k in range(n + 1):
        total += prob
        if total > chance:
            return k
        prob *= (n - k) / (k + 1) * p / (1 - p)
    return n


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, h1 and h2 (of the whole set), parts (the partial keys), mins (a byte of each minhash)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            sh, at = _text_sets(texts, width)
            n = np.diff(at)
            some = n > 0
            first = (np.cumsum(n) - n)[some]
            h1, h2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            low = np.zeros((len(texts), 2 * K * M), np.uint64)
            if len(first):
                h1[some] = np.add.reduceat(mix(sh + np.uint64(1)), first)
                h2[some] = np.add.reduceat(mix(sh ^ np.uint64(0xD6E8FEB86659FD93)), first)
                for k in range(2 * K * M):
                    low[some, k] = np.minimum.reduceat((sh ^ _XOR[k]) * _MUL[k], first)
            parts = np.zeros((len(texts), 2 * M), np.uint64)
            for k in range(K):
                parts = mix(parts * np.uint64(0x9E3779B97F4A7C15) + low[:, k::K])
            lists = _lists(parts.ravel(), np.arange(len(texts) + 1) * 2 * M)
            mins = pa.array([x.tobytes() for x in (mix(low) & np.uint64(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1.astype(np.int64, casting="unsafe")), pa.array(h2.astype(np.int64, casting="unsafe")), lists, mins],
                ["doc_id", "mark", "n_shingles", "h1", "h2", "parts", "mins"],
            )

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))).mapInArrow(run, f"doc_id {id_type}, mark bigint, n_shingles bigint, h1 bigint, h2 bigint, parts array<bigint>, mins binary")


def verified(pairs: DataFrame, docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough."""
    texts = only(docs.where("text IS NOT NULL").select("doc_id", "text"), pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for batch, tb in text_chunks(batches, "tb", 1 << 20):
            ta = batch.column(2).cast(pa.large_binary()).to_pylist()
            where: dict[bytes, int] = {}
            rows = [(where.setdefault(x, len(where)), where.setdefault(y, len(where))) for x, y in zip(ta, tb)]
            sh, at = shingles(*word_hashes(list(where), NOT_SPACE), width)
            sets: dict[int, np.ndarray] = {}
            keep = []
            for x, y in rows:
                for k in (x, y):
                    if k not in sets:
                        sets[k] = np.unique(sh[at[k] : at[k + 1]])
                n = len(sets[x]) + len(sets[y])
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True)) if x != y else n // 2
                keep.append(both > 0 and 100 * both >= similarity * (n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return small_batches(both).mapInArrow(run, f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: int = SIMILARITY, marked: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs; if marked, also mark, the xxhash64 of the text, which tells the texts of one id apart."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(sketches(docs, width), "sketches")
    own = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # one representative of each set; ids whose sets are equal are linked through it
    sets = own.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.any_value("parts").alias("parts"), F.any_value("mins").alias("mins"))
    sets = scratch.keep(sets.select("id", "n_shingles", "parts", "mins", "h1", "h2"), "sets")
    keys = F.expr(f"flatten(transform(sequence(0, {M - 1}), i -> transform(sequence(0, {M - 1}), j -> xxhash64(i * {M} + j, parts[i], parts[{M} + j]))))")
    keyed = sets.select(F.explode(keys).alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    members = scratch.keep(keyed.join(shared, "key"), "members")
    del keyed, shared
    scratch.drop()

    hubs = members.groupBy("id").agg(F.sum("n").alias("hub"))
    # what the following plans read is written: cached frames would stand in them with all their own plans, once for each use
    ranked = scratch.keep(members.join(hubs, "id").select("key", "id", "hub"), "ranked")
    # the largest hub leads, of equal ones the smallest id
    lead = ranked.groupBy("key").agg(F.max("hub").alias("hub")).join(ranked, ["key", "hub"]).groupBy("key").agg(F.min("id").alias("lead"))
    pairs = ranked.join(lead, "key").where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    pairs = scratch.keep(_likely(pairs, sets, similarity), "pairs")
    scratch.drop(ranked)
    links = scratch.keep(verified(pairs, docs, width, similarity), "links")
    scratch.drop(pairs)
    label = components(links, scratch)
    named = members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rest = scratch.keep(named.join(split, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct(), "rest")
    if not rest.isEmpty():
        texts = scratch.keep(only(docs, rest).join(rest, "doc_id", "left_semi"), "rest-texts")
        scratch.drop(rest, members, links)
        label = _by_rarest(texts, sets, label, width, similarity, scratch)
        scratch.drop(texts)

    # rows of one id may have several sets, so sets are named by the component of their representative, and ids by the least of these
    named = sets.join(label, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component"))
    out = sketch.select("doc_id", "mark", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *["mark"] * marked, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _text_sets(texts: list[bytes], width: int):
    """The distinct shingles of all texts, sorted within each, and where each text's begin."""
    sh, at = shingles(*word_hashes(texts, NOT_SPACE), width)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.append(True, (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1]))[: len(sh)]
    sh, owner = sh[new], owner[new]
    return sh, np.searchsorted(owner, np.arange(len(texts) + 1))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int64, casting="unsafe")))


def _rarest(texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """key, id, n and x: the shingles that a link must share one of, by rarity, and how many stand before each."""

    def every(batches):
        for _, data in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([_lists(*_text_sets(data, width))], ["sh"])

    count = small_batches(texts.select("text")).mapInArrow(every, "sh array<bigint>").select(F.explode("sh").alias("sh")).groupBy("sh").agg(F.count("*").alias("n"))
    found = count.where("n >= 20").orderBy(F.desc("n"), "sh").limit(FREQUENT).collect()
    frequent = np.array([r[0] for r in found], np.int64).astype(np.uint64, casting="unsafe")
    by_hash = np.argsort(frequent)
    frequent, place = frequent[by_hash], len(found) - by_hash  # the most frequent comes last
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def prefixes(batches):
        for batch, data in text_chunks(batches, "text"):
            sh, at = _text_sets(data, width)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(data)), n)
            late = np.zeros(len(sh), np.int64)
            if len(frequent):
                k = np.minimum(np.searchsorted(frequent, sh), len(frequent) - 1)
                late = np.where(frequent[k] == sh, place[k], 0)
            order = np.lexsort((sh, late, owner))
            sh, x = sh[order], np.arange(len(sh)) - at[:-1][owner]
            need = n - -(-n * similarity // 100) + 1
            keep = x < need[owner]
            rows = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sh[keep].astype(np.int64, casting="unsafe")), batch.column(0).take(pa.array(rows)), pa.array(n[rows], pa.int64()), pa.array(x[keep], pa.int64())],
                ["key", "id", "n", "x"],
            )

    return small_batches(texts.select("doc_id", "text")).mapInArrow(prefixes, f"key bigint, id {id_type}, n bigint, x bigint")


def _by_rarest(texts: DataFrame, sets: DataFrame, label: DataFrame, width: int, similarity: int, scratch: Scratch) -> DataFrame:
    """The components after all links among these documents. label: id, component so far."""
    rows = scratch.keep(_rarest(texts.where("text IS NOT NULL"), width, similarity).distinct(), "rarest")
    slack = 100 / similarity - 1 + 1e-9  # x + y is at most this part of the intersection
    light = lambda x, n: (100 + similarity) * F.col(x) <= (100 - similarity) * F.col(n)
    rounds = 0
    while True:
        rounds += 1
        named = rows.join(label, "id", "left").select("key", "id", "n", "x", F.coalesce("component", "id").alias("label"))
        parts = named.groupBy("key", "label").agg(F.count("*").alias("rows"), F.count_if(light("x", "n")).alias("lights"), F.min("id").alias("head"))
        split = parts.groupBy("key").agg(
            F.max(F.struct("rows", "label", "lights")).alias("most"), F.sum("rows").alias("rows"), F.sum("lights").alias("lights"), F.count("*").alias("labels"), F.min(F.struct("rows", "label", "head")).alias("least")
        )
        # a light row meets all rows of its bucket, another one the light rows
        minor, minor_lights = F.col("rows") - F.col("most.rows"), F.col("lights") - F.col("most.lights")
        met = minor_lights * F.col("rows") + (minor - minor_lights) * F.col("lights")
        split = split.where("labels > 1 AND lights > 0").select("key", F.col("most.label").alias("major"), F.col("least.head").alias("head"), met.alias("met"))
        rest = scratch.keep(named.join(split, "key"), "rest")
        if rest.isEmpty():
            scratch.drop(rest, rows)
            return label
        share = F.lit(ROUND_PAIRS) / F.greatest(F.col("met"), F.lit(1))
        picked = (F.col("id") == F.col("head")) | (F.pmod(F.xxhash64("key", "id", F.lit(rounds)), F.lit(1 << 20)) < share * (1 << 20))
        lead = rest.where((F.col("label") != F.col("major")) & picked)
        lead = scratch.keep(lead.select("key", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("label").alias("other")), "lead")
        inter = F.least(F.col("n") - F.col("x"), F.col("m") - F.col("y"))
        near = (F.col("x") + F.col("y") <= slack * inter) & ((100 + similarity) * inter >= similarity * (F.col("n") + F.col("m")))
        some = rest.where(light("x", "n")).join(lead, "key").where((F.col("label") != F.col("other")) & near)
        more = rest.where(~light("x", "n")).join(lead.where(light("y", "m")), "key").where((F.col("label") != F.col("other")) & near)
        pairs = scratch.keep(_likely(some.union(more).select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct(), sets, similarity), "pairs")
        new = scratch.keep(verified(pairs, texts, width, similarity), "links")
        # components so far are edges of the next
        after = label
        if not new.isEmpty():
            after = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new.select("a", "b")), scratch)
        left = rest.select("key", "id", "n", "x").join(lead.select("key", F.col("lead").alias("id")), ["key", "id"], "left_anti")
        left = scratch.keep(left, "rarest")
        scratch.drop(rows, rest, lead, pairs, new)
        rows, label = left, after


def _likely(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs within the bounds of size and of agreeing minhashes."""
    side = lambda x: sets.groupBy("id").agg(F.min("n_shingles").alias("n"), F.max("n_shingles").alias("m"), F.any_value("mins").alias("s")).select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"), F.col("s").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    several = (F.col("na") < F.col("ma")) | (F.col("nb") < F.col("mb"))  # an id with several sets is left to the verification
    sized = 100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    agree = F.expr(" + ".join(f"if(substring(sa, {k}, 1) = substring(sb, {k}, 1), 1, 0)" for k in range(1, 2 * K * M + 1)))
    return both.where(several | (sized & (agree >= least_agreement(similarity)))).select("a", "b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, b.y FROM r JOIN b ON r.m = b.x),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
