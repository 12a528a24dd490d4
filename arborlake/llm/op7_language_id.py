"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of a letter trigram binds (multiplies) the
letters' vectors, permuted by their place; a document's vector bundles (adds) those of all its
trigrams; a language's prototype bundles the directions of documents of that language. The language
with the largest cosine wins; equal cosines go to the first in the order of names.

Fitted on a bounded sample: about SAMPLE_PER_LANGUAGE documents of each language, whole, of SAMPLE_CHARS
characters on average at the most. Prediction reads whole texts. Texts are counted in pieces, and
trigrams are bound and bundled a slice at a time, so memory does not grow with texts or alphabets.

Defined cases: a null text, or one with no letter, is `und` with score 0; without any labelled
document all are `und`; an empty table gives no rows; repeated rows return as often as they came;
only the id, text and (to learn) language columns are read. Profiles are learnt from a bounded sample of
whole texts (sampling.labelled_sample: some 10,000 rows in all) of the 1,000 most frequent languages; one beyond these
is never answered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import text_chunks
from .common import small_batches, table
from .sampling import held_out, labelled_sample

DIMENSIONS = 1024
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000

#: Codes of letters: 1 to 26 for a to z, the others share the rest by their code point; 0 is no letter.
CODES = 128
_SEED = 7
#: Characters that are counted, and trigrams that are bound, at once.
PIECE, SLICE = 1 << 19, 4096


@lru_cache
def _code_table() -> np.ndarray:
    """The code of every code point."""
    cp = np.arange(0x110000, dtype=np.int64)
    out = (27 + (cp * 2654435761 >> 7) % (CODES - 27)).astype(np.uint8)
    out[~np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, len(out))] = 0
    out[97:123] = np.arange(1, 27)
    return out


class Profiles:
    """Vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.Generator(np.random.PCG64(_SEED))
        letters = rng.integers(0, 2, (CODES, dimensions), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.codes = _code_table()

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors and whether they have a letter."""
        out, some = np.zeros((len(texts), self.places[0].shape[1]), np.float32), np.zeros(len(texts), bool)
        parts, rows, size = [], [], 0
        for row, text in enumerate(map(str.lower, texts)):
            for i in range(0, len(text), PIECE):  # with the characters around it
                parts.append((text[i - 1] if i else "\n") + text[i : i + PIECE] + text[i + PIECE : i + PIECE + 1].ljust(1, "\n"))
                rows.append(row)
                size += len(parts[-1])
                if size > PIECE:
                    self._bundle(parts, rows, out, some)
                    parts, rows, size = [], [], 0
        self._bundle(parts, rows, out, some)
        return out, some

    def _bundle(self, parts: list[str], rows: list[int], out: np.ndarray, some: np.ndarray) -> None:
        """Adds the trigrams of the parts, but for those around their first and last characters, to the rows' vectors."""
        if not parts:
            return
        code = self.codes[np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
        ends = np.cumsum([len(p) for p in parts])
        centre = code != 0
        centre[ends - 1] = centre[np.concatenate(([0], ends[:-1]))] = False
        at = np.flatnonzero(centre)
        tri = (code[at - 1] * CODES + code[at]) * CODES + code[at + 1]
        part = np.searchsorted(ends, at, side="right")
        seen = np.flatnonzero(np.bincount(tri, minlength=CODES**3))
        place = np.zeros(CODES**3, np.int32)
        place[seen] = np.arange(len(seen))
        tri = place[tri]
        if len(seen) > SLICE:
            order = np.argsort(tri, kind="stable")
            tri, part = tri[order], part[order]
        for i in range(0, len(seen), SLICE):
            own = seen[i : i + SLICE]
            lo, hi = (0, len(tri)) if len(seen) <= SLICE else np.searchsorted(tri, (i, i + SLICE))
            # few parts at once, as their counts are held by trigram
            for k in range(0, len(parts), 128):
                n = min(128, len(parts) - k)
                mine = slice(lo, hi) if len(parts) <= 128 else lo + np.flatnonzero((part[lo:hi] >= k) & (part[lo:hi] < k + n))
                counts = np.bincount((part[mine] - k) * len(own) + tri[mine] - i, minlength=n * len(own)).reshape(n, len(own)).astype(np.float32)
                a, b, c = (p[x] for p, x in zip(self.places, (own // CODES**2, own // CODES % CODES, own % CODES)))
                np.add.at(out, rows[k : k + n], counts @ (a * b * c).astype(np.float32))
        some[np.asarray(rows)[np.unique(part)]] = True


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def in_blocks(texts: list[str], rows: int = 128, chars: int = 1 << 20):
    """Lists of few texts each, so that counts by text and trigram stay small."""
    block, size = [], 0
    for t in texts:
        if block and (len(block) >= rows or size + len(t) > chars):
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def train(docs: DataFrame, lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their prototypes. docs: doc_id, text and lang of the rows to learn from."""
    sample = labelled_sample(docs.select("doc_id", "text", F.col(lang_col).alias("lang")), "lang", per_language, SAMPLE_CHARS)
    names = sorted({lang for _, lang in sample})
    profiles, sums = Profiles(), np.zeros((len(names), DIMENSIONS))
    at = {name: i for i, name in enumerate(names)}
    sample.sort(key=lambda x: (x[1], x[0]))
    for block in in_blocks([t for t, _ in sample]):
        langs, sample = [at[x] for _, x in sample[: len(block)]], sample[len(block) :]
        np.add.at(sums, langs, unit(profiles.vectors(block)[0]))
    return names, unit(sums).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of every text; row has the columns to be carried along."""
    row = [F.struct(*carry).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + "".join(f", row {slim.schema['row'].dataType.simpleString()}" for _ in row)

    carried = len(row)

    def run(batches):
        profiles = Profiles()
        for batch, data in text_chunks(batches, "text"):
            langs, scores = [], []
            for block in in_blocks([(t or b"").decode("utf-8", "replace") for t in data]):
                x, some = profiles.vectors(block)
                cos = unit(x) @ prototypes.T if names else np.zeros((len(block), 1))
                best = cos.argmax(1)
                langs += [names[i] if s and names else "und" for i, s in zip(best, some)]
                scores += [round(min(1.0, max(0.0, float(c[i]))), 5) if s else 0.0 for c, i, s in zip(cos, best, some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *["row"] * carried])

    return small_batches(slim).mapInArrow(run, schema)


def identify(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Learns from three quarters of the documents and predicts all."""
    names, prototypes = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs, names, prototypes, carry=carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
