"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are figures of the line itself and of the lines before
and after it; neighbouring labels are tied by transition weights. The document's score is the mean of
its lines' forward-backward marginals of being good, weighted by the lines' lengths, and calibrated by
a logistic curve on the training documents.

Trained on the driver on a bounded sample: about SAMPLE_PER_LABEL documents of each label, whole, of
SAMPLE_CHARS characters on average at the most; a document's label is the label of all its lines.
Scoring reads whole texts.

Defined cases: a null or empty text, or one without words, gets the score of a document with nothing
good about it (0); without labelled rows of both kinds every other score is 0.5; a text is scored by itself, so
there are no ties; texts may be of any length and are read whole; an empty table gives no rows; repeated rows return as often as they came; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import NOT_SPACE, text_chunks, word_hashes
from .common import small_batches, table
from .sampling import held_out, labelled_sample

SAMPLE_PER_LABEL = 700
SAMPLE_CHARS = 20_000
#: From this score on a document is predicted to be good.
GOOD_FROM = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "symbol": b"#*$%&<>",
    "bar": b"|",
    "shout": b"!",
    "stop": b".,;:?",
    "other": b"@[]{}()=+/\\^~_\"`",
    "beyond": range(0x80, 0x100),
}
_MASKS = []
for _members in _CLASSES.values():
    _m = np.zeros(256, bool)
    _m[list(_members)] = True
    _MASKS.append(_m)


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, the lines' bytes, and where each text's lines begin (one more at the end)."""
    lines, counts = [], []
    for t in texts:
        own = [x for x in (t or b"").split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines += own
        counts.append(len(own))
    at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)
    if not lines:
        return np.zeros((0, 3 * (len(_MASKS) + 7) + 2), np.float32), np.zeros(0), at
    size = np.array([len(x) for x in lines], np.int64)
    buf, first = np.frombuffer(b"".join(lines), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1]))
    cols = [np.add.reduceat(m[buf], first, dtype=np.int64) / size for m in _MASKS]
    words, w_at = word_hashes(lines, NOT_SPACE)
    n = np.diff(w_at)
    line_of = np.repeat(np.arange(len(lines)), n)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    start = w_at[:-1]
    cols.append(np.add.reduceat(again, start) / n)
    # distinct words of a line, and lines equal to an earlier line of the text
    _, at_first = np.unique(words * np.uint64(0x9E3779B97F4A7C15) + line_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
    cols.append(np.bincount(line_of[at_first], minlength=len(lines)) / n)
    doc_of = np.repeat(np.arange(len(texts)), counts)
    order = np.arange(len(words), dtype=np.uint64) - np.repeat(start, n).astype(np.uint64)
    whole = np.add.reduceat(words * (2 * order + np.uint64(1)), start) + doc_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, at_first = np.unique(whole, return_index=True)
    repeat = np.ones(len(lines))
    repeat[at_first] = 0
    cols.append(repeat)
    cols += [np.log1p(n) / 5, np.minimum(size / n, 30) / 10, n < 4]
    last = buf[first + size - 1]
    cols.append(last == ord("."))
    own = np.stack(cols, 1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    begins, ends = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    some = np.diff(at) > 0
    begins[at[:-1][some]], ends[at[1:][some] - 1] = True, True
    before[begins], after[ends] = 0, 0
    return np.hstack([own, before, after, begins[:, None], ends[:, None]]).astype(np.float32), size.astype(float), at


def alike(n: np.ndarray, most: int = 200_000):
    """Groups of texts of similar numbers of lines, at most `most` lines together where there are several; texts without lines are in none."""
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * n[order[j]] <= most and n[order[j]] <= 2 * n[order[i]]:
            j += 1
        yield order[i:j]
        i = j


def padded(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers by text and step, and which of them there are."""
    n = np.diff(at)[rows]
    steps = np.arange(n.max())
    real = steps[None, :] < n[:, None]
    return np.where(real, at[rows][:, None] + steps[None, :], 0), real


def marginals(score: np.ndarray, real: np.ndarray, tie: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over texts at once. score: the log-odds of good by text and step. tie: 2x2 transition weights.

    Returns the marginals of good and, if the texts' shares are given, the expected transitions by share.
    """
    rows, steps = score.shape
    node = np.stack([np.zeros_like(score), score], 2)
    fwd, bwd = np.zeros((rows, steps, 2)), np.zeros((rows, steps, 2))
    fwd[:, 0] = node[:, 0]
    for t in range(1, steps):
        new = node[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + tie[0], fwd[:, t - 1, 1, None] + tie[1])
        fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
    for t in range(steps - 2, -1, -1):
        nxt = node[:, t + 1] + bwd[:, t + 1]
        new = np.logaddexp(nxt[:, 0, None] + tie[:, 0], nxt[:, 1, None] + tie[:, 1])
        bwd[:, t] = np.where(real[:, t + 1, None], new, bwd[:, t + 1])
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    good = np.exp(np.minimum(0, fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]))
    pair = np.zeros((2, 2))
    if share is not None:
        for a in range(2):
            for b in range(2):
                p = np.exp(np.minimum(0, fwd[:, :-1, a] + tie[a, b] + node[:, 1:, b] + bwd[:, 1:, b] - z[:, None]))
                pair[a, b] = (np.where(real[:, 1:], p, 0) * share[:, None]).sum()
    return good, pair


def train(sample: list[tuple[str, int]], rounds: int = 150, decay: float = 1e-3) -> dict:
    """Weights by Adam on the conditional likelihood, lines of long documents weighing less; then the calibration."""
    sample = sorted(sample, key=lambda x: (x[1], x[0]))
    y = np.array([int(label) for _, label in sample])
    if len(set(y.tolist())) < 2:
        return {}
    x, size, at = line_features([t.encode() for t, _ in sample])
    groups = [(rows, *padded(at, rows)) for rows in alike(np.diff(at))]
    mean, std = x.mean(0), x.std(0) + 1e-3
    xs = (x - mean) / std
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.maximum(1, np.diff(at))
    params = np.zeros(x.shape[1] + 1 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for r in range(1, rounds + 1):
        w, bias, tie = params[: x.shape[1]], params[x.shape[1]], params[-4:].reshape(2, 2)
        odds, per_line, expected = xs @ w + bias, np.zeros(len(x)), np.zeros((2, 2))
        for rows, idx, real in groups:
            good, pair = marginals(np.where(real, odds[idx], 0), real, tie, share[rows])
            expected += pair
            per_line[idx[real]] = ((y[rows, None] - good) * share[rows, None])[real]
        g = np.zeros_like(params)
        g[: x.shape[1]], g[x.shape[1]] = per_line @ xs - decay * w, per_line.sum()
        # transitions: seen less expected, on texts' shares of weight
        seen = np.zeros((2, 2))
        pairs = np.maximum(0, np.diff(at) - 1) * share
        seen[0, 0], seen[1, 1] = pairs[y == 0].sum(), pairs[y == 1].sum()
        g[-4:] = (seen - expected).ravel() - 0.05 * params[-4:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model = {"w": params[: x.shape[1]] / std, "bias": params[x.shape[1]] - (mean / std) @ params[: x.shape[1]], "tie": params[-4:].reshape(2, 2)}
    raw, some = raw_scores(model, x, size, at)
    # a logistic curve over the raw score, with the sample's balance of labels
    z, yy = np.log((raw[some] + 0.01) / (1.01 - raw[some])), y[some]
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = max(0.05, a + 0.05 * ((yy - p) * z).mean()), b + 0.05 * (yy - p).mean()
    return model | {"curve": (a, b)}


def raw_scores(model: dict, x: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted marginals by text, and whether it has a line. Texts of similar numbers of lines go together."""
    n = np.diff(at)
    out = np.zeros(len(n))
    if len(x):
        odds = x @ model["w"] + model["bias"]
        for rows in alike(n):
            idx, real = padded(at, rows)
            good = marginals(np.where(real, odds[idx], 0), real, model["tie"])[0]
            weight = np.where(real, size[idx], 0)
            out[rows] = (good * weight).sum(1) / weight.sum(1)
    return out, n > 0


def scores(model: dict, texts: list[bytes | None]) -> np.ndarray:
    x, size, at = line_features(texts)
    if not model:
        return np.where(np.diff(at) > 0, 0.5, 0.0)
    raw, some = raw_scores(model, x, size, at)
    a, b = model["curve"]
    z = np.log((raw + 0.01) / (1.01 - raw))
    return np.where(some, 1 / (1 + np.exp(-(a * z + b))), 0.0)


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            s = np.round(scores(model, texts), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return small_batches(slim).mapInArrow(run, f"doc_id {id_type}, score double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Learns from labelled documents whose id's crc32 leaves a remainder other than 0 by 5."""
    own = labels.select("doc_id", F.col(label_col).alias("label")).where(~held_out(F.col("doc_id"), 5, 0)).where("label IS NOT NULL AND doc_id IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"))
    # as many labels as are needed are picked before they meet the texts
    n = own.count()
    share = min(1_000_000, 1_000_000 * 20 * per_label // max(1, n))
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(own) if 20 * per_label <= 50_000 else own, "doc_id")
    return train(labelled_sample(rows, "label", per_label, SAMPLE_CHARS, 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
