"""Texts as numpy arrays: bounded chunks of Arrow batches, words as 64-bit hashes, shingles.

Everything works on UTF-8 bytes. Only A-Z are lower-cased, which bytes.lower() does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as numpy arrays at once.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_SPACE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in text whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd number and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(batches, column: str, most: int = CHUNK_BYTES):
    """Yields (record batch, UTF-8 texts or None), a few MB of text at a time."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), col.slice(i, j - i).to_pylist()
            i = j


def _hash_piece(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a piece's words, in order, and the bytes they begin at.

    A word's hash is a polynomial of random numbers for its bytes, taken from running sums over the piece.
    """
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = is_word[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(data: bytes, most: int):
    """Cuts a long text behind white space."""
    i = 0
    while i < len(data):
        j = i + most
        while j < len(data) and not _SPACE[data[j]]:
            j += 1
        yield data[i:j]
        i = j


def word_hashes(texts, is_word: np.ndarray = NOT_SPACE, most: int = CHUNK_BYTES):
    """texts: bytes or None. Returns all words' hashes and, for each text, where its words begin (one more at the end)."""
    hashes, counts = [], []
    small, small_n = [], 0

    def flush():
        nonlocal small, small_n
        if not small:
            return
        h, starts = _hash_piece(b"\n".join(small), is_word)
        text_ends = np.cumsum([len(x) + 1 for x in small])
        counts.extend(np.diff(np.searchsorted(starts, text_ends), prepend=0).tolist())
        hashes.append(h)
        small, small_n = [], 0

    for t in texts:
        data = (t or b"").lower()
        if len(data) > most:
            flush()
            parts = [_hash_piece(p, is_word)[0] for p in _pieces(data, most)]
            hashes.extend(parts)
            counts.append(sum(map(len, parts)))
        else:
            small.append(data)
            small_n += len(data)
            if small_n > most:
                flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def shingles(words: np.ndarray, at: np.ndarray, width: int, short: bool = True):
    """Hashes of each text's `width`-word shingles in order, and where each text's begin.

    short: a text with fewer words, but not none, has its whole sequence as the one shingle.
    """
    n = np.diff(at)
    number = np.maximum(n - width + 1, 0)
    brief = (n > 0) & (n < width) if short else np.zeros(len(n), bool)
    number[brief] = 1
    out_at = np.concatenate(([0], np.cumsum(number)))
    out = np.zeros(out_at[-1], np.uint64)
    if len(words) >= width:
        every = words[: len(words) - width + 1] * _STEP[0]
        for k in range(1, width):
            every += words[k : len(words) - width + 1 + k] * _STEP[k]
        within = np.ones(len(every), bool)  # not across two texts
        for k in range(1, width):
            edge = at[1:-1] - k
            within[edge[(edge >= 0) & (edge < len(every))]] = False
        full = np.ones(len(out), bool)
        full[out_at[:-1][brief]] = False
        out[full] = every[within] + np.uint64(width)
    for d in np.flatnonzero(brief):
        own = words[at[d] : at[d + 1]]
        out[out_at[d]] = (own * _STEP[: len(own)]).sum() + np.uint64(len(own))
    return mix(out), out_at
