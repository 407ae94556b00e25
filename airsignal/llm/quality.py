"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: how often its words fall in each of ``BUCKETS`` hash buckets (logarithmic, scaled to length 1),
and a few statistics of its structure (share of capitals, digits, symbols and line breaks, word
lengths, repeats, variety) and its metadata (number of characters). The machine scores a text by a bias, a
weight per feature and the products of all pairs of features, whose weights are inner products of short factor
vectors; the pairs are summed in linear time as half of the squared sum less the sum of squares.

Results: null, empty and blank texts have statistics of zero and are scored like any other; repeated rows score
alike. If the sample lacks one of the labels, every text scores the share of the other. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import IS_SPACE, Powers, byte_pieces, labelled_sample, range_hashes, text_buffer, with_chars, words_of

#: Hash buckets of words and length of the factor vectors.
BUCKETS, FACTORS = 1024, 8
#: Bounds of the training sample: rows of each label, characters of a text.
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 20_000
#: Rows whose features are held at once.
ROWS = 512

STATISTICS = ["log_chars", "log_words", "word_length", "capitals", "digits", "marks", "symbols", "breaks", "bytes_over_127",
              "same_as_before", "same_as_two_before", "variety", "commonest", "short_words", "long_words", "marked_words"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CAPITALS = _class(bytes(range(65, 91)))
_DIGITS = _class(b"0123456789")
_MARKS = _class(b".,;:!?'\"()-")
_SYMBOLS = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:!?'\"()-"))
_BREAKS = _class(b"\n\r")
_HIGH = (np.arange(256) > 127).astype(np.int64)
_STARTS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)  # bytes that begin a character
_CLASSES = np.stack([_STARTS, _CAPITALS, _DIGITS, _MARKS, _SYMBOLS, _BREAKS, _HIGH])


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_FOLD = _lower()


def features(texts: pa.Array, powers: Powers) -> np.ndarray:
    """Rows of BUCKETS word features and len(STATISTICS) statistics, from sums over stretches of the texts."""
    n = len(texts)
    words = np.zeros((n, BUCKETS), np.float32)
    sums = np.zeros((n, len(_CLASSES)))
    extra = np.zeros((n, 7))  # words, their bytes, equal to the one before, to two before, short, long, with a mark inside
    data, offsets = text_buffer(texts)
    for piece, off in byte_pieces(data, offsets):
        rows = np.flatnonzero(off[1:] > off[:-1])
        if not len(rows):
            continue
        for k, table in enumerate(_CLASSES):
            sums[rows, k] += np.add.reduceat(table[piece], off[rows])
        start, end, row = words_of(piece, off, IS_SPACE)
        if not len(start):
            continue
        h = range_hashes(_FOLD[piece], start, end, powers)
        words += np.bincount(row * BUCKETS + (h >> np.uint64(54)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        size = end - start
        odd = np.append(0, np.cumsum(_SYMBOLS[piece]))
        same = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        two = np.append([False] * min(2, len(h)), (h[2:] == h[:-2]) & (row[2:] == row[:-2]))
        for k, v in enumerate((1, size, same, two, size <= 2, size >= 16, odd[end] > odd[start])):
            extra[:, k] += np.bincount(row, np.broadcast_to(v, row.shape).astype(float), minlength=n)
    chars, (count, length, same, two, short, long, odd) = np.maximum(sums[:, 0], 1), np.maximum(extra, 0).T
    some = np.maximum(count, 1)
    variety = (words > 0).sum(axis=1) / np.maximum(1, BUCKETS * -np.expm1(-count / BUCKETS))  # against words that never repeat
    stats = np.stack([np.log1p(sums[:, 0]) / 10, np.log1p(count) / 8, np.minimum(length / some, 40) / 10, sums[:, 1] / chars * 2, sums[:, 2] / chars * 4,
                      sums[:, 3] / chars * 8, sums[:, 4] / chars * 8, sums[:, 5] / chars * 16, sums[:, 6] / chars, same / some * 4, two / some * 4,
                      np.minimum(variety, 2), words.max(axis=1) / some * 2, short / some, long / some * 4, odd / some * 2], axis=1)
    words = np.log1p(words)
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    return np.hstack([words, np.minimum(stats, 4)]).astype(np.float32)


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def decisions(x: np.ndarray, m: Model) -> np.ndarray:
    """Bias, weights and all pairwise products, the pairs by the sum-of-squares identity."""
    return m.bias + x @ m.weight + 0.5 * ((x @ m.factor) ** 2 - (x * x) @ (m.factor ** 2)).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Logistic loss by Adam on mini-batches; the same sample gives the same model."""
    share = float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(0)
    d = x.shape[1] if len(x) else BUCKETS + len(STATISTICS)
    params = [np.array([np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))]), np.zeros(d), rng.normal(0, 0.02, (d, factors))]
    if share in (0.0, 1.0):
        return Model(30.0 if share else -30.0, params[1], params[2] * 0)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            i = order[at:at + 256]
            xb, step = x[i].astype(float), step + 1
            inner = xb @ params[2]
            z = params[0][0] + xb @ params[1] + 0.5 * (inner ** 2 - (xb * xb) @ (params[2] ** 2)).sum(axis=1)
            g = (sigmoid(z) - y[i]) / len(i)
            grads = [np.array([g.sum()]), xb.T @ g + decay * params[1],
                     xb.T @ (g[:, None] * inner) - ((xb * xb).T @ g)[:, None] * params[2] + decay * params[2]]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = params[k] - lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows (doc_id, quality) given; the bias is set back to the labels' true shares."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    rows, counts = labelled_sample(docs, with_chars(docs, known), "quality", rows_per_label, max_chars)
    y = np.array([r.quality for r in rows], float)
    texts, powers = pa.array([r.text for r in rows], pa.string()), Powers()
    x = np.vstack([features(texts[i:i + ROWS], powers) for i in range(0, len(rows), ROWS)] or [np.zeros((0, BUCKETS + len(STATISTICS)), np.float32)])
    model = train(x, y)
    if 0 < y.sum() < len(y):
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (FACTORS + 1) numbers

    def run(batches):
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                s = sigmoid(decisions(features(part.column("text"), powers), held.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))
