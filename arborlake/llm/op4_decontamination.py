"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). A
window's three-word shingles are ordered by how often they occur in all documents; for full
containment the necessary prefix is one shingle, the rarest. Document shingles are joined with these
prefix shingles; a match fixes where the window would have to stand in the document, which the length
and position bounds reject or which is then compared word by word.

The benchmark is taken in blocks of at most BLOCK_CHARS characters, each an index that is broadcast
(a stated query set against all rows, in blocks); documents are never shuffled.

Defined cases: a null or empty text has no words and no hits; null, empty or word-less items have no
window; repeated items and windows count once per item id; a tie between the rarest
shingles of a window does not change what is found; texts may be of any length and are read whole; items with a null id are ignored; an empty
table gives no rows or no hits; repeated rows return as often as they came; only the id and text
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ALNUM, mix, shingles, text_chunks, word_hashes
from .common import small_batches, table

WINDOW = 13
SHINGLE = 3
BLOCK_CHARS = 2_000_000
_BITS = 20


class Index:
    """Windows of a block of items, found by their rarest shingle."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        items = sorted({(str(i), t) for i, t in items if i is not None and t})
        self.words, at = word_hashes([t.encode() for _, t in items], ALNUM)
        n = np.diff(at)
        size = np.minimum(n, window)
        number = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), number)
        first = np.cumsum(number) - number
        start = np.arange(number.sum()) - np.repeat(first, number) + at[owner]
        length = size[owner]
        # equal windows are kept once, with the list of their items
        names = sorted({i for i, _ in items})
        where = {x: k for k, x in enumerate(names)}
        name_of = np.array([where[i] for i, _ in items], np.int64)
        whole = np.zeros(len(start), np.uint64)
        for k in range(window):
            ok = k < length
            whole[ok] = mix(whole[ok] * np.uint64(0x9E3779B97F4A7C15) + self.words[start[ok] + k])
        whole += length.astype(np.uint64)
        _, keep, group = np.unique(whole, return_index=True, return_inverse=True)
        self.names, self.start, self.length = names, start[keep], length[keep]
        pairs = np.unique(group.astype(np.int64) * max(1, len(names)) + name_of[owner]) if len(start) else np.zeros(0, np.int64)
        self.item_at = np.searchsorted(pairs // max(1, len(names)), np.arange(len(keep) + 1))
        self.item = pairs % max(1, len(names))
        # shingles of the windows: of three words, or of all words of a shorter window
        self.widths = sorted({int(x) for x in np.minimum(self.length, SHINGLE)})
        offsets, hashes, owners = [], [], []
        for k in range(window - min(SHINGLE, window) + 1):
            for width in self.widths:
                some = np.flatnonzero((np.minimum(self.length, SHINGLE) == width) & (k + width <= self.length))
                if len(some):
                    sub, _ = shingles(self.words[(self.start[some] + k)[:, None] + np.arange(width)].ravel(), np.arange(len(some) + 1) * width, width, short=False)
                    owners.append(some)
                    offsets.append(np.full(len(some), k))
                    hashes.append(sub)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.sh_owner, self.sh_offset, self.sh_hash = cat(owners, np.int64), cat(offsets, np.int64), cat(hashes, np.uint64)
        self.keys = np.unique(self.sh_hash)
        self.bits = self._bitmap(self.keys)

    @staticmethod
    def _bitmap(keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return bits

    def found(self, words: np.ndarray, at: np.ndarray, keys: np.ndarray, bits: np.ndarray):
        """Words and key numbers of the texts' shingles that are keys."""
        where, which = [], []
        for width in self.widths:
            sh, sh_at = shingles(words, at, width, short=False)
            hit = np.flatnonzero(bits[(sh >> np.uint64(64 - _BITS)).astype(np.int64)])
            if len(hit):
                k = np.minimum(np.searchsorted(keys, sh[hit]), len(keys) - 1)
                ok = keys[k] == sh[hit]
                hit, k = hit[ok], k[ok]
                doc = np.searchsorted(sh_at, hit, side="right") - 1
                where.append(hit - sh_at[doc] + at[doc])
                which.append(k)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(where), cat(which)

    def order(self, counts: np.ndarray) -> None:
        """Takes as each window's prefix its rarest shingle. counts: occurrences in all documents, by key."""
        rarity = counts[np.searchsorted(self.keys, self.sh_hash)]
        order = np.lexsort((self.sh_offset, self.sh_hash, rarity, self.sh_owner))
        first = order[np.append(True, np.diff(self.sh_owner[order]) > 0)] if len(order) else order
        by_key = first[np.argsort(self.sh_hash[first], kind="stable")]
        self.prefix, at = np.unique(self.sh_hash[by_key], return_index=True)
        self.prefix_at = np.append(at, len(by_key))
        self.prefix_window, self.prefix_offset = self.sh_owner[by_key], self.sh_offset[by_key]
        self.bits = self._bitmap(self.prefix)
        self.sh_owner = self.sh_offset = self.sh_hash = self.keys = None

    def hits(self, words: np.ndarray, at: np.ndarray):
        """First word and window of every occurrence of a window in the texts."""
        where, which = self.found(words, at, self.prefix, self.bits)
        number = self.prefix_at[which + 1] - self.prefix_at[which]
        starts, windows = [], []
        for i, j in _blocks(number, 200_000):
            n = number[i:j]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.prefix_at[which[i:j]], n)
            place, window = np.repeat(where[i:j], n), self.prefix_window[entry]
            doc = np.searchsorted(at, place, side="right") - 1
            start, length = place - self.prefix_offset[entry], self.length[window]
            ok = (start >= at[doc]) & (start + length <= at[doc + 1])
            start, window, length = start[ok], window[ok], length[ok]
            for k in range(int(length.max(initial=0))):
                same = (k >= length) | (words[np.minimum(start + k, len(words) - 1)] == self.words[np.minimum(self.start[window] + k, len(self.words) - 1)])
                start, window, length = start[same], window[same], length[same]
            starts.append(start)
            windows.append(window)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(starts), cat(windows)


def _blocks(number: np.ndarray, most: int):
    """Ranges of entries whose numbers add up to about `most`."""
    if len(number):
        cut = np.flatnonzero(np.diff(np.cumsum(number) // most)) + 1
        edges = [0, *cut.tolist(), len(number)]
        yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def shingle_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each key of the index occurs in all documents (docs: text)."""

    def run(batches):
        total = np.zeros(len(index.keys), np.int64)
        for _, texts in text_chunks(batches, "text"):
            _, which = index.found(*word_hashes(texts, ALNUM), index.keys, index.bits)
            total += np.bincount(which, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    out = np.zeros(len(index.keys), np.int64)
    if len(out):
        for k, n in small_batches(docs.select("text")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).toLocalIterator():
            out[k] = n
    return out


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of words (first, one past the last)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(docs: DataFrame, index: Index, last: bool) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    row = [f"row {docs.schema['row'].dataType.simpleString()}"] if "row" in docs.columns else []

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            words, at = word_hashes(texts, ALNUM)
            start, window = index.hits(words, at)
            doc = np.searchsorted(at, start, side="right") - 1
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for d in np.unique(doc).tolist():
                own = doc == d
                a, w = start[own] - at[d], window[own]
                new = zip(a.tolist(), (a + index.length[w]).tolist())
                spans[d] = [{"start": x, "end": y} for x, y in merged([*new, *((s["start"], s["end"]) for s in spans[d])])]
                names = {index.names[i] for k in np.unique(w) for i in index.item[index.item_at[k] : index.item_at[k + 1]]}
                items[d] = sorted(names.union(items[d]))
            text = pa.nulls(len(texts), pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(np.diff(at), pa.int64()), *batch.columns[4:]],
                ["doc_id", "text", "spans", "items", "n_words", *["row"] * len(row)],
            )

    schema = ", ".join([f"doc_id {id_type}, text string, spans array<struct<start:bigint,end:bigint>>, items array<string>, n_words bigint", *row])
    return small_batches(docs.select("doc_id", "text", "spans", "items", *["row"] * len(row))).mapInArrow(run, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """doc_id, n_words, spans of hit words, and the sorted ids of the items with occurring windows; row has the columns to be carried along."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND length(t) > 0")
    chars = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    row = [F.struct(*carry).alias("row")] if carry else []
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    slim = out.select("text")
    out = out.withColumns({"spans": F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)"), "items": F.expr("cast(array() AS array<string>)")})
    for b in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        index = Index([tuple(r) for r in own.collect()])
        index.order(shingle_counts(slim, index))
        out = _search(out, index, b == blocks - 1)
    return out.select("doc_id", "n_words", "spans", "items", *["row"] * len(row))


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, the hit words, and contaminated: hits on at least a twentieth of the words."""
    out = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
c AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, ws[i:i + k - 1] AS win FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM c)),
sizes AS (SELECT DISTINCT k FROM w),
g AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
m AS (SELECT g.doc_id, g.i, g.k, w.item_id FROM g JOIN w ON g.k = w.k AND g.win = w.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
