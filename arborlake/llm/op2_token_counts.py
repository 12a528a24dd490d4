"""Token counts by rank-synchronous merging of byte-pair encodings.

A text is normalised and cut into pre-tokens as the tokenizer file says. The pre-tokens that a
bounded memo lacks are held as one ragged numpy array of symbols; in each step every sequence merges
all occurrences of its own lowest-rank pair at once, until no sequence has a pair that the file
lists. What is left of a sequence is its number of tokens. A sequence of more than LONG symbols takes
the same steps by itself, over its pairs' places grouped by rank, so that a step costs what it merges
and not the length of the sequence.

Defined cases: a null text is empty and has no tokens; an empty table gives no rows; rows are counted
one by one, so repeated rows return as often as they came; long texts and long words are cut nowhere;
of overlapping pairs of one rank, the only ties, the first is merged; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import text_chunks
from .common import small_batches, table

#: More tokens than this is over the limit.
TOKEN_LIMIT = 2048
#: Pre-tokens whose counts a worker remembers.
MEMO = 200_000
#: Bytes beyond which a pre-token is merged by itself and not remembered.
LONG = 512

_NONE = np.iinfo(np.int64).max


def _every_other(beside: np.ndarray) -> np.ndarray:
    """Which places are taken: of overlapping ones, as in "aaa", the first, third and so on. beside: whether each but the first overlaps the one before."""
    i = np.arange(len(beside) + 1)
    return (i - np.maximum.accumulate(np.where(np.append(True, ~beside), i, 0))) % 2 == 0


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class RankCounter:
    """Counts the tokens of texts by the merges of a tokenizers file (byte-level, with or without a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_symbols()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = len(vocab)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.memo: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merged_length(self, word: str) -> int:
        """The number of symbols left of one word, which is not empty."""
        buf = np.frombuffer(word.encode("utf-8"), np.uint8)
        n = left = len(buf)
        sym = self.inner[buf]
        sym[-1] = self.last[buf[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # neighbours still there; n is the end
        rank = np.append(self.ranks(sym[:-1], sym[1:]), _NONE)  # of the pair that begins at a place
        heap: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            edges = [0, *(np.flatnonzero(np.diff(rank[at])) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:]):
                if i < j:
                    r = int(rank[at[i]])
                    if r not in places:
                        heapq.heappush(heap, r)
                    places.setdefault(r, []).append(at[i:j])

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[_every_other(after[at[:-1]] == at[1:])]
            gone = after[at]
            sym[at], after[at] = self.made[r], after[gone]
            before[after[at]] = at
            rank[gone] = _NONE
            left -= len(at)
            near = np.concatenate((before[at], at))
            near = np.unique(near[near >= 0])
            rank[near] = _NONE
            inner = near[after[near] < n]
            rank[inner] = self.ranks(sym[inner], sym[after[inner]])
            wait(inner)
        return left

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """The number of symbols left of each word (none is empty)."""
        data = [w.encode("utf-8") for w in words]
        n = np.fromiter(map(len, data), np.int64, len(data))
        buf = np.frombuffer(b"".join(data), np.uint8)
        sym, seq = self.inner[buf], np.repeat(np.arange(len(words)), n)
        ends = np.cumsum(n) - 1
        sym[ends] = self.last[buf[ends]]
        out = np.zeros(len(words), np.int64)
        while len(sym):
            same = seq[1:] == seq[:-1]
            rank = np.append(np.where(same, self.ranks(sym[:-1], sym[1:]), _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            done = least == _NONE
            out[seq[starts[done]]] = size[done]
            hit = (rank != _NONE) & (rank == np.repeat(least, size))
            run = np.flatnonzero(hit)
            if len(run):
                run = run[_every_other(np.diff(run) == 1)]
            sym[run] = self.made[rank[run]]
            stay = ~np.repeat(done, size)
            stay[run + 1] = False
            sym, seq = sym[stay], seq[stay]
        return out

    def pretokens(self, text: str) -> list[str]:
        # up to U+024F lower-casing is by single characters and nothing composes, but for the dotted capital I
        if _PLAIN(text):
            text = text.lower()
        else:
            text = self.normalizer.normalize_str(text)
        return self.find(text)

    def counts(self, texts: list[str]) -> list[int]:
        fixed, parts = [], []
        for t in texts:
            found = len(self.special.findall(t)) if self.special else 0
            fixed.append(found)
            if found:
                parts.append([p for x in self.special.split(t) for p in self.pretokens(x)])
            else:
                parts.append(self.pretokens(t))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list(set().union(*parts).difference(memo))
        long = [w for w in new if len(w) * 4 > LONG and len(w.encode("utf-8")) > LONG]
        if long:
            new = list(set(new).difference(long))
        if new:
            memo.update(zip(new, self.merged_lengths(new).tolist()))
        memo.update((w, self.merged_length(w)) for w in long)
        out = [n + sum(map(memo.__getitem__, p)) for n, p in zip(fixed, parts)]
        for w in long:  # so that the memo's size in bytes is bounded too
            del memo[w]
        return out


_PLAIN = regex.compile("[\u0000-įı-ɏ]*+").fullmatch


@lru_cache(maxsize=2)
def counter(path: str) -> RankCounter:
    return RankCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = counter(path).counts
        for batch, texts in text_chunks(batches, "text"):
            n = counts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return small_batches(slim).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
