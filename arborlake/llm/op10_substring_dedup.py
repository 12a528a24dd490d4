"""Near-duplicate passages across documents by compact windows.

A text is its sequence of five-word shingles. For each of HASHES hash functions the Cartesian tree over
the shingles' hashes groups all subsequences that share a minimum. Of a node only what concerns passages
of PASSAGE words is kept: its compact window is the place c of the minimum and the range of starts
(first, last) of those passages whose first minimum stands at c. A function's windows are disjoint
ranges of starts, about 2n / PASSAGE of them, and together they cover every passage.

Two passages of Jaccard similarity s share a minimum with probability s under each function, and count
as candidates if they do under AGREE of the functions: with 4 and 2, that is 0.973 at s = 0.8, where a
passage of 50 words stands with one word edited; longer ones have more passages of 50 words to be found
by. Minima that no other document has are dropped first. Then, within each text, the windows left of
every two functions are joined by the overlap of their ranges of starts: an overlap is a group of
passages that share both minima. Overlaps of different documents meet by the two minima, so nothing is
counted by pairs of documents.

In a bucket every overlap is held against one of the first document (smallest doc_id): from the common
shingle the passages are grown on both documents as long as eight in nine shingles match near the
diagonal, which is where a similarity of 0.8 lies, and verified on their full shingle sets. A passage
begins and ends with a shingle that the other one has: 49 equal words and an edited one are no passage.

A bucket's first member does not speak for all pairs, so passages of PASSAGE equal words go on to buckets
of their own. Such a passage of B and C holds its minimum c with WIDE words of it on one side at least. If
both differ from the bucket's first member A, they either differ from it at the same place, in front of
or behind c, and in the same word, or the passage is A's too. So every member goes on to the bucket of
the words from c to the place where it leaves A, and that word, at least WIDE words long and within a
passage of the overlap. There it is held against that bucket's first member, until no bucket holds two
documents. Each such bucket is a longer equal run than the one before, of PASSAGE words at the most, so
only copied text goes on, a bounded number of times, and each passage of PASSAGE equal words is found. The buckets of the first two functions are enough for that, as every passage has a pair of them.

Equal texts are one: only the one with the smallest doc_id is looked at, the others are passages of it
as a whole. Returned are the passages of a document that repeat an earlier document's (a smaller
doc_id), as word ranges. Repeats within one document are not passages across documents.

Defined cases: a null or empty text, or one of under 50 words, has no passages; rows with a null id
are returned without any; rows of one id are one document, and each of its texts has its own passages;
of tied documents the smallest id is the first holder; texts may be of any length and are read whole; an empty table gives no rows; only the id and
text columns are read, and other columns may have any names.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .chunks import NOT_SPACE, mix, shingles, text_chunks, word_hashes
from .common import ID_ROWS, Scratch, fresh, join_checked, small_batches, table

SHINGLE = 5
#: Words of the shortest passage.
PASSAGE = 50
#: Similarity, as a per cent of intersection to union of the shingle sets.
SIMILARITY = 80
#: Hash functions, and how many have to agree.
HASHES, AGREE = 4, 2
#: Words that every window of PASSAGE words holds from its minimum on, or up to the minimum's end.
WIDE = (PASSAGE + SHINGLE) // 2
#: Words that may be inserted or deleted between two copies at one place.
BAND = 8
#: Pairs that share one sending of their first document's text.
SLICE = 64

_LEAST = PASSAGE - SHINGLE + 1
_rng = np.random.Generator(np.random.PCG64(10))
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = _rng.integers(0, 2**63, 4 * PASSAGE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `size` neighbours, by doubling."""
    done = 1
    while 2 * done <= size:
        x = best(x[: len(x) - done], x[done:])
        done *= 2
    rest = size - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def compact_windows(h: np.ndarray, at: np.ndarray, least: int = _LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of minima in the texts' joined hashes, and the first and last start of the `least` shingles they are minimal in.

    These are the Cartesian trees' nodes whose range holds `least` shingles, from left to right. The
    minimum of all neighbours is slid over the hashes, their upper halves joined with their places, so
    that of equal ones the first wins; starts that follow each other with one minimum are one window.
    """
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, none, none
    low = np.uint64(0xFFFFFFFF)
    c = (_slide((h & ~low) | np.arange(len(h), dtype=np.uint64), least, np.minimum) & low).astype(np.int64)
    ends = np.repeat(at[1:], np.diff(at))[: len(c)]
    start = np.flatnonzero(np.arange(len(c)) + least <= ends)  # not across two texts
    if not len(start):
        return none, none, none
    c = c[start]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (start[1:] != start[:-1] + 1))))
    return c[first], start[first], start[np.append(first[1:], len(start)) - 1]


def text_windows(sh: np.ndarray, at: np.ndarray):
    """Texts, keys and spots of all compact windows, by text. A spot is the place, the way back to the first start, the starts less one, and the function."""
    texts, keys, spots = [], [], []
    for k in range(HASHES):
        c, first, last = compact_windows((sh ^ _XOR[k]) * _MUL[k], at)
        text = np.searchsorted(at, c, side="right") - 1
        texts.append(text)
        keys.append(mix(sh[c] + _XOR[k]))
        spots.append((((c - at[text]) << 6 | c - first) << 6 | last - first) << 2 | k)
    text = np.concatenate(texts)
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate(keys)[order], np.concatenate(spots)[order]


def pack(before, after, back, reach):
    return before | after << 6 | back << 12 | reach << 18


def overlaps(text: np.ndarray, keys: np.ndarray, spots: np.ndarray):
    """The interval join within the texts: rows, keys and places of all overlaps of two functions' windows, and their states.

    A state is what a bucket's members are known to share, `before` words in front of and `after` from the minimum on,
    and how far the overlap's passages go, `back` and `reach` words at the most. It is 0 but for the first two functions.
    """
    place, back, more, k = spots >> 14, spots >> 8 & 63, spots >> 2 & 63, spots & 3
    first = (text << 36) + place - back
    own = []
    for f in range(HASHES):
        i = np.flatnonzero(k == f)
        own.append(i[np.argsort(first[i], kind="stable")])
    out = []
    for f, g in combinations(range(HASHES), AGREE):
        a, b = own[f], own[g]
        lo = np.searchsorted(first[b] + more[b], first[a], side="left")
        n = np.maximum(0, np.searchsorted(first[b], first[a] + more[a], side="right") - lo)
        i = np.repeat(a, n)
        j = b[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else i
        state = np.zeros(len(i), np.int64)
        if (f, g) == (0, 1):
            c = first[i] + back[i]
            state = pack(0, SHINGLE, c - np.maximum(first[i], first[j]), np.minimum(first[i] + more[i], first[j] + more[j]) + PASSAGE - c)
        out.append((text[i], mix(keys[i] * np.uint64(3) + mix(keys[j] + np.uint64(f * HASHES + g))), place[i], state))
    return tuple(map(np.concatenate, zip(*out)))


def _lists(at: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)


def windows_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark, digest, n_words and the compact windows (keys, spots) of every document. docs: doc_id, mark, digest, text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            words, at = word_hashes(texts, NOT_SPACE)
            sh, sh_at = shingles(words, at, SHINGLE, short=False)
            text, keys, spots = text_windows(sh, sh_at)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = [_lists(offsets, pa.array(x.astype(np.int64, casting="unsafe"))) for x in (keys, spots)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int64()), *lists], ["doc_id", "mark", "digest", "n_words", "keys", "spots"])

    return small_batches(docs.select("doc_id", "mark", "digest", "text")).mapInArrow(run, f"doc_id {id_type}, mark bigint, digest string, n_words bigint, keys array<bigint>, spots array<bigint>")


def overlaps_table(units: DataFrame) -> DataFrame:
    """key, doc_id, mark and spots (place << 24 | state) of all overlaps, a row for each key of a text. units: doc_id, mark, keys, spots."""
    id_type = units.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, spots = (batch.column(i) for i in (2, 3))
            n = keys.value_lengths().to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (keys, spots)]
            text, key, place, state = overlaps(np.repeat(np.arange(batch.num_rows), n), flat[0].astype(np.uint64, casting="unsafe"), flat[1])
            order = np.lexsort((place, key, text))
            text, key, spot = text[order], key[order].astype(np.int64, casting="unsafe"), (place << 24 | state)[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (text[1:] != text[:-1]))))
            ends = np.append(new[1:], len(key))
            for i in range(0, len(new), 50_000):
                at, to = new[i : i + 50_000], ends[i : i + 50_000]
                ids = pa.array(text[at])
                lists = _lists(np.append(at, to[-1]) - at[0], pa.array(spot[at[0] : to[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column(0).take(ids), batch.column(1).take(ids), lists], ["key", "doc_id", "mark", "spots"])

    return small_batches(units.select("doc_id", "mark", "keys", "spots")).mapInArrow(run, f"key bigint, doc_id {id_type}, mark bigint, spots array<bigint>")


def _longest(match: np.ndarray, c: int, cost: int) -> tuple[int, int]:
    """The longest range around c whose ends match and where `cost` in `cost` + 1 match at least."""
    score = np.where(match, 1, -cost)
    left = np.cumsum(score[c::-1])
    right = np.concatenate(([0], np.cumsum(score[c + 1 :])))
    # the best sum that reaches at least so far to the left never rises with the reach
    reach = np.maximum.accumulate(left[::-1])[::-1]
    far = np.searchsorted(-reach, right, side="right") - 1
    length = np.where(far >= 0, far + np.arange(len(right)), -1)
    y = int(length.argmax())
    if length[y] < 0:
        return c, c
    a, b = c - int(far[y]), c + y + 1
    inside = np.flatnonzero(match[a:b])
    return a + int(inside[0]), a + int(inside[-1]) + 1


def _near(x: np.ndarray, y: np.ndarray, x_lo: int, x_hi: int, shift: int) -> np.ndarray:
    """Which of x[x_lo:x_hi] stand in y within BAND of the diagonal y = x + shift."""
    lo, hi = x_lo + shift - BAND, x_hi + shift + BAND
    part = np.zeros(hi - lo, np.uint64)
    a, b = max(lo, 0), min(hi, len(y))
    if b > a:
        part[a - lo : b - lo] = y[a:b]
    own = x[x_lo:x_hi]
    out = own == part[BAND : BAND + len(own)]
    miss = np.flatnonzero(~out)
    if 8 * len(miss) < len(own):
        out[miss] = (part[miss[:, None] + np.arange(2 * BAND + 1)] == own[miss, None]).any(1)
    else:
        for e in range(2 * BAND + 1):
            out |= own == part[e : e + len(own)]
    return out


def grow(sa: np.ndarray, sb: np.ndarray, ca: int, cb: int, cost: int) -> tuple[int, int, int, int]:
    """The ranges of shingles on both documents around a common one."""
    half = 96
    while True:
        out, cut = [], False
        for x, y, c, shift in ((sa, sb, ca, cb - ca), (sb, sa, cb, ca - cb)):
            lo, hi = max(0, c - half), min(len(x), c + half + 1)
            a, b = _longest(_near(x, y, lo, hi, shift), c - lo, cost)
            cut |= (a < 32 and lo > 0) or (b > hi - lo - 32 and hi < len(x))
            out += [lo + a, lo + b]
        if not cut:
            return tuple(out)
        half *= 4


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    step = 64
    i = 0
    while i < n:
        differ = np.flatnonzero(x[i : min(n, i + step)] != y[i : min(n, i + step)])
        if len(differ):
            return i + int(differ[0])
        i += step
        step *= 4
    return n


def passage(sa, sb, ca: int, cb: int, left: int, right: int, similarity: int):
    """The widest verified ranges around a common shingle, or None; at the least the run of equal words."""
    for cost in (8, 16, 32):
        a0, a1, b0, b1 = grow(sa, sb, ca, cb, cost)
        if min(a1 - a0, b1 - b0) < _LEAST:
            break
        x, y = np.unique(sa[a0:a1]), np.unique(sb[b0:b1])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= similarity * (len(x) + len(y) - both):
            return a0, a1, b0, b1
    end = right - SHINGLE + 1
    return (ca - left, ca + end, cb - left, cb + end) if left + right >= PASSAGE else None


def goes_on(words: np.ndarray, c: int, left: int, right: int, state: int) -> list[tuple[int, int]]:
    """(key, state) of the buckets that a member goes on to, which has `left` words in front of c and `right` from c on in common with its bucket's first member.

    Only runs that lie in one passage of the overlap: others have another minimum, which goes on instead.
    """
    before, after, back, reach = (state >> k & 63 for k in (0, 6, 12, 18))
    if before + after >= WIDE:
        runs = [(before, right + 1), (left + 1, after)]
    else:
        most = WIDE - SHINGLE
        runs = [(0, WIDE)] if right < WIDE else [(0, right + 1), (left + 1, WIDE)]
        runs += [(most, SHINGLE)] if left < most else [(left + 1, SHINGLE), (most, right + 1)]
    out = []
    for x, y in runs:
        if x <= back and y <= reach and x + y <= PASSAGE:
            run = int((words[c - x : c + y] * _RUN[: x + y]).sum(dtype=np.uint64))
            key = ((run ^ run >> 31) * 0xBF58476D1CE4E5B9 + (x * 1000 + y) * 0x94D049BB133111EB) % (1 << 64)
            out.append(((key ^ key >> 29) - (1 << 63), pack(x, y, back, reach)))
    return out


def equal_beside(wa: np.ndarray, wb: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words in front of and from places ca and cb on, counted up to PASSAGE."""
    out = []
    for step, start in ((-1, -1), (1, 0)):
        i, j = (c[:, None] + start + step * np.arange(PASSAGE) for c in (ca, cb))
        same = (i >= 0) & (j >= 0) & (i < len(wa)) & (j < len(wb))
        same &= wa[np.clip(i, 0, len(wa) - 1)] == wb[np.clip(j, 0, len(wb) - 1)]
        out.append(np.where(same.all(1), PASSAGE, same.argmin(1)))
    return tuple(out)


def hold_against(wa, sa, wb, sb, anchors, similarity: int = SIMILARITY, whole: bool = True):
    """Verified passages (start, end, start in the first document, end) in words, and the buckets that the members go on to, with their places.

    anchors: place in the first document, place and state. whole: else only what goes on is wanted.
    """
    spans, more, equal, lo, hi = [], [], [], 0, 0  # lo, hi: the last words that equal runs cover
    failed = set()
    anchors = np.array(sorted(anchors, key=lambda x: (x[1], x[0])), np.int64).reshape(-1, 3)
    anchors = anchors[(anchors[:, 0] < len(sa)) & (anchors[:, 1] < len(sb))]
    anchors = anchors[sa[anchors[:, 0]] == sb[anchors[:, 1]]]
    parts = [equal_beside(wa, wb, part[:, 0], part[:, 1]) for part in np.split(anchors, range(4096, len(anchors), 4096))]
    lefts, rights = (np.concatenate(x).tolist() for x in zip(*parts))
    for (ca, cb, state), left, right in zip(anchors.tolist(), lefts, rights):
        known = any(s[0] <= cb and cb + SHINGLE <= s[1] and s[2] <= ca and ca + SHINGLE <= s[3] for s in spans[-8:])
        if not state and (known or not whole):
            continue
        if state:
            more += [(*x, cb) for x in goes_on(wb, cb, left, right, state)]
        if not whole or left + right >= PASSAGE and lo <= cb - left and cb + right <= hi:
            continue
        if left + right >= PASSAGE:
            left, right = _same(wa[:ca][::-1], wb[:cb][::-1]), _same(wa[ca:], wb[cb:])
            equal.append((cb - left, cb + right, ca - left))
            lo, hi = (lo, max(hi, cb + right)) if lo <= cb - left <= hi else (cb - left, cb + right)
        run = (cb - left, cb + right, ca - left)
        if known or run in failed:
            continue
        found = passage(sa, sb, ca, cb, left, right, similarity)
        if found:
            a0, a1, b0, b1 = found
            spans.append((b0, b1 + SHINGLE - 1, a0, a1 + SHINGLE - 1))
        else:
            failed.add(run)  # another shingle of the same run would grow alike
    if whole:
        spans.sort()
        reach, k, inner = 0, 0, []
        for b, end, a in sorted(equal):  # equal runs within a verified passage are the same passage
            while k < len(spans) and spans[k][0] <= b:
                reach, k = max(reach, spans[k][1]), k + 1
            if end > reach:
                inner.append((b, end, a, a + end - b))
        spans += inner
    return spans, more


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs: a, am, b, bm and anchors. Returns a, b, bm, spans and more.

    Texts and anchors meet in the worker, sorted by first document and slice of its partners: the first document's
    text, then the anchors and the text of each partner. So no text is shuffled for a join where the list of who needs
    which is small enough to be broadcast, and a first document's text is sent once for every SLICE of its partners.
    """
    slices = pairs.groupBy("a", "am").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    slice_ = F.pmod(F.xxhash64("b", "bm"), F.col("slices")).cast("int").alias("slice")
    own = pairs.join(slices, ["a", "am"]).select("a", "am", slice_, "b", "bm", "anchors")
    first = slices.select("a", "am", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    needs = own.select(F.col("b").alias("doc_id"), F.col("bm").alias("mark"), "a", "am", "slice", "b", "bm")
    needs = needs.unionByName(first.select(F.col("a").alias("doc_id"), F.col("am").alias("mark"), "a", "am", "slice"), allowMissingColumns=True)
    texts = join_checked(docs.select("doc_id", "mark", "text"), needs, ["doc_id", "mark"], "inner", ID_ROWS).drop("doc_id", "mark")
    both = own.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select("a", "am", "slice", "b", "bm", "anchors", "text", "kind").repartition("a", "am", "slice").sortWithinPartitions("a", "am", "slice", F.asc_nulls_first("b"), "bm", "kind")
    id_type = pairs.schema["a"].dataType.simpleString()

    def table_of(rows, names):
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, len(names))
        return _lists(at, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(len(names))], names))

    def run(batches):
        at_first, wa, sa, at_next, anchors = None, None, None, None, None
        for batch, texts in text_chunks(batches, "text"):
            words, at = word_hashes(texts, NOT_SPACE)
            sh, sh_at = shingles(words, at, SHINGLE, short=False)
            a, am, b, bm, kind = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 7))
            # the anchors of all rows: a place of the first document with all spots of its partner
            each = batch.column(5).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lead, spots = batch.column(5).flatten().flatten()
            n = spots.value_lengths().to_numpy(zero_copy_only=False)
            anchor_at = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(each)))]
            lead = np.repeat(lead.to_numpy(zero_copy_only=False), n).tolist()
            spots = spots.flatten().to_numpy(zero_copy_only=False)
            place, state = (spots >> 24).tolist(), (spots & 0xFFFFFF).tolist()
            keep, spans, more = [], [], []
            for k in range(batch.num_rows):
                w, s = words[at[k] : at[k + 1]], sh[sh_at[k] : sh_at[k + 1]]
                if b[k] is None:
                    at_first, wa, sa = (a[k], am[k]), w.copy(), s.copy()
                elif not kind[k]:
                    own = slice(anchor_at[k], anchor_at[k + 1])
                    at_next, anchors = (b[k], bm[k]), set(zip(lead[own], place[own], state[own]))
                elif at_first == (a[k], am[k]) and at_next == (b[k], bm[k]):
                    found, on = hold_against(wa, sa, w, s, anchors, whole=a[k] != b[k])
                    keep.append(k)
                    spans.append(found)
                    more.append(on)
            take = pa.array(keep, pa.int64())
            out = [table_of(spans, ["start", "end", "first_start", "first_end"]), table_of(more, ["key", "state", "place"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 3, 4)), *out], ["a", "b", "bm", "spans", "more"])

    schema = f"a {id_type}, b {id_type}, bm bigint, spans array<struct<start:bigint,end:bigint,first_start:bigint,first_end:bigint>>, more array<struct<key:bigint,state:bigint,place:bigint>>"
    return small_batches(both).mapInArrow(run, schema)


def _round(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Holds every member against its bucket's first document. rows: key, doc_id, mark, spots.

    Of the first document's places any may stand for it. One picked by hash is seldom the first of many, as
    in periodic text, where the places behind it would leave it one period further on in each round.
    """
    lead = rows.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "spots")).alias("lead"), F.max("doc_id").alias("high")).where("lead.doc_id < high")
    place = F.shiftright(F.expr("get(lead.spots, cast(pmod(xxhash64(key), size(lead.spots)) as int))"), 24).cast("int")
    lead = lead.select("key", F.col("lead.doc_id").alias("a"), F.col("lead.mark").alias("am"), place.alias("lead"))
    pairs = rows.join(lead, "key").where("doc_id > a OR mark <> am OR size(spots) > 1")
    pairs = pairs.groupBy("a", "am", F.col("doc_id").alias("b"), F.col("mark").alias("bm")).agg(F.collect_list(F.struct("lead", "spots")).alias("anchors"))
    pairs = scratch.keep(pairs, "pairs")
    held = scratch.keep(_verify(pairs, docs), "held")
    scratch.drop(pairs)
    return held


def passages(docs: DataFrame, scratch: Scratch, units: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, mark, of (the earlier document), start, end, first_start, first_end of every verified passage of a unit, in words.

    docs: doc_id, mark, text. units: doc_id, mark, keys, spots of every text that is looked at, taken
    from windows, which is dropped once the overlaps are written.
    """
    nodes = units.select("doc_id", "mark", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("spots").alias("spot"))))
    shared = nodes.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    own = nodes.join(shared, "key").groupBy("doc_id", "mark").agg(F.collect_list("key").alias("keys"), F.collect_list("spot").alias("spots"))
    rows = scratch.keep(overlaps_table(own), "overlaps")
    del nodes, shared, own
    scratch.drop(windows)
    found = []
    while True:
        held = _round(rows, docs, scratch)
        found.append(held.select(F.col("b").alias("doc_id"), F.col("bm").alias("mark"), F.col("a").alias("of"), F.inline("spans")))
        more = held.select(F.col("b").alias("doc_id"), F.col("bm").alias("mark"), F.inline("more"))
        after = scratch.hold(more.groupBy("key", "doc_id", "mark").agg(F.sort_array(F.collect_set(F.col("place") * (1 << 24) + F.col("state"))).alias("spots")))
        scratch.drop(rows)
        rows = after
        if rows.isEmpty():
            break
        if len(found) == 1:  # what goes on is far less
            docs = scratch.keep(join_checked(docs, rows.select("doc_id", "mark").distinct(), ["doc_id", "mark"], "left_semi", ID_ROWS), "texts")
    return reduce(DataFrame.union, found).distinct()


def _marked(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark and text. The mark tells the texts of one id apart; it is 0 if all rows of the id have the same text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    several = docs.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("doc_id", F.lit(True).alias("several"))
    several = scratch.keep(several, "several")
    if several.isEmpty():
        return docs.withColumn("mark", F.lit(0).cast("bigint"))
    return join_checked(docs, several, "doc_id", "left").select("doc_id", F.when(F.col("several"), F.col("mark")).otherwise(F.lit(0)).alias("mark"), "text")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, mark, n_words), a row each, and the passages (doc_id, mark, of, start, end, first_start, first_end) that repeat earlier documents'.

    mark is 0, or a hash of the text if the id has several texts.
    """
    scratch = Scratch(docs.sparkSession)
    docs = _marked(docs, scratch, id_col, text_col)
    windows = scratch.keep(windows_table(docs.withColumn("digest", F.md5("text"))), "windows")
    lengths = scratch.keep(windows.select("doc_id", "mark", "digest", "n_words"), "lengths")
    first = lengths.groupBy("digest").agg(F.min("doc_id").alias("of"))
    copies = scratch.keep(lengths.join(first, "digest").where("of < doc_id").select("doc_id", "mark", "of", "n_words").distinct(), "copies")
    units = windows.where("doc_id IS NOT NULL AND size(keys) > 0").select("doc_id", "mark", "keys", "spots")
    units = join_checked(units, copies.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti", ID_ROWS)
    found = scratch.keep(passages(docs.where("doc_id IS NOT NULL"), scratch, units, windows), "passages")
    zero, n = F.lit(0).cast("bigint"), F.col("n_words")
    whole = copies.where(n >= PASSAGE).select("doc_id", "mark", "of", zero.alias("start"), n.alias("end"), zero.alias("first_start"), n.alias("first_end"))
    return lengths.drop("digest"), found.union(whole)


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the passages taken out of their texts; a document of which no word is left goes."""
    the_id, the_mark, the_spans = fresh(docs, "passages_id", "passages_mark", "passages")
    spans = found.groupBy(F.col("doc_id").alias(the_id), F.col("mark").alias(the_mark)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(the_spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = join_checked(docs, spans, (F.col(id_col) == F.col(the_id)) & F.col(the_mark).isin(F.lit(0), F.xxhash64(text)), "left").drop(the_id, the_mark)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch, texts in text_chunks(batches, text_col):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            new, keep = [], []
            for t, s in zip(texts, spans):
                left = without(t, [(x["start"], x["end"]) for x in s]) if s and t is not None else t
                new.append(left)
                keep.append(not s or bool(left.strip(b" \t\n\r\x0b\x0c")))
            cols = batch.columns[:-1]
            cols[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return small_batches(joined).mapInArrow(run, schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these ranges of words, and without the white space behind them."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, done = [], 0
    for a, b in sorted(spans):
        a, b = words[a][0], words[b][0] if b < len(words) else len(text)
        if a > done:
            out.append(text[done:a])
        done = max(done, b)
    return b"".join([*out, text[done:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, found = repeated_passages(table(spark, sf_dir, "documents"))
    # words in the union of the ranges, by one pass over them in order
    covered = F.expr(
        "aggregate(sort_array(collect_set(struct(start, end))), named_struct('to', 0L, 'n', 0L), "
        "(s, x) -> named_struct('to', greatest(s.to, x.end), 'n', s.n + greatest(0L, x.end - greatest(s.to, x.start)))).n"
    )
    own = found.groupBy("doc_id", "mark").agg(covered.alias("n_dup_words"), F.count("*").alias("n_passages"), F.sort_array(F.collect_set("of")).alias("repeats"))
    classes = components(found.select("of", "doc_id"))
    out = lengths.join(own, ["doc_id", "mark"], "left").join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_words", zero("n_dup_words"), zero("n_passages"), "repeats", F.coalesce("component", "doc_id").alias("class_id"))
