"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are cut where the split pattern cannot match across: before white space that follows
something else, or between a letter and a digit. Pieces give the same ids as the whole text. A run of
white space holds no boundary and the library's matcher keeps a step back for each of its characters,
so runs of more than RUN_CHARS are matched by the `regex` module and each match goes to the library
as one piece. Decoding joins raw bytes, so a token may hold part of a character.

Defined cases: a null text is empty, has no ids and decodes to nothing; an empty table gives no rows;
repeated rows return as often as they came; a text's ids depend on nothing but the text, so there are
no ties; white space, words and numbers may be of any length; extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import text_chunks
from .common import small_batches, table

#: Texts of more characters are cut into pieces of about so many.
PIECE_CHARS = 1 << 18
#: White-space runs of more characters are matched outside the library.
RUN_CHARS = 1 << 16

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: Tried at the start of a run only.
_RUN = regex.compile(rf"(?<!\s)\s{{{RUN_CHARS},}}+")
#: Takes any text as one piece.
WHOLE = r"(?s:.+)"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS):
    """The text's pieces; one that has no safe boundary stays whole."""
    i = 0
    while len(text) - i > most:
        found = _SAFE.search(text, i + most)
        if not found:
            break
        yield text[i : found.start()]
        i = found.start()
    yield text[i:]


def split_runs(text: str, pattern: str):
    """(part, whether it is one match of the pattern); only what a long run of white space touches is matched here."""
    split, done = regex.compile(pattern), 0
    for run in _RUN.finditer(text):
        if run.start() < done:
            continue
        yield text[done : run.start()], False  # no match goes on from something else into white space
        done = run.start()
        while done < run.end():
            match = split.match(text, done)
            if not match or match.end() == done:
                break
            yield match[0], True
            done = match.end()
    yield text[done:], False


def encode_text(path: str, pattern: str, text: str) -> list[int]:
    enc = encoding(path, pattern)
    if len(text) <= RUN_CHARS:
        return enc.encode_ordinary(text)
    out, whole = [], encoding(path, WHOLE)
    for part, is_match in split_runs(text, pattern):
        for piece in (part,) if is_match else pieces(part):
            out += (whole if is_match else enc).encode_ordinary(piece)
    return out


def _ids_array(lists: list[list[int]]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.fromiter((x for ids in lists for x in ids), np.int32, at[-1])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False) -> DataFrame:
    """doc_id and ids of every text; decode_too adds decoded, the bytes that the ids stand for."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for batch, texts in text_chunks(batches, "text"):
            ids = [encode_text(path, pattern, t.decode("utf-8", "replace")) for t in texts]
            cols, names = [batch.column(0), _ids_array(ids)], ["doc_id", "ids"]
            if decode_too:
                cols.append(pa.array([enc.decode_bytes(x) for x in ids], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return small_batches(slim).mapInArrow(run, f"doc_id {id_type}, ids array<int>" + ", decoded binary" * decode_too)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (bytes) of every list of ids; null is empty."""
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.expr("cast(array() AS array<int>)")).alias("ids"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return small_batches(slim).mapInArrow(run, f"doc_id {id_type}, decoded binary")


def digests(round_trip: DataFrame) -> DataFrame:
    return round_trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    docs = table(spark, sf_dir, "documents")
    return digests(encode(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, decode_too=True))
