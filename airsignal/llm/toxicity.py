"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The strings are the words of sentences: runs of non-space bytes, lower-cased in ASCII; letters spaced out one by one
are one word, and a word over ``WORD_BYTES`` bytes is the windows of ``WINDOW`` bytes in it, ``STRIDE`` apart. Words with other
characters than letters count in three forms: as they are, their letters alone ("id*iot", "i.d.i.o.t"), and each run of letters ("/the-idiot.html"). Two words are compared by their common subsequences of four
letters, gaps allowed up to a span of ``SPAN`` + 1 bytes, each weighted by ``DECAY`` to the power of its span, and divided by what words of
their lengths can reach. Gaps tolerate inserted characters ("id*iot") and letters left out.

Training sees documents with labels: every sentence of a clean document is clean, and of a toxic one at
least one sentence is toxic. Landmarks are words of the sample; the kernel values against them, whitened
(Nyström), feed a linear support vector machine with squared hinge loss, solved by Newton steps. Rounds
alternate between choosing the most toxic words of each toxic document, with the hardest words of clean ones
against them, and training. A document's score is a logistic curve over its most toxic word.

The kernel has an explicit feature for each four letters, so the sum over landmarks is folded into one
weight per four letters, and a text is scored by table look-ups in linear time, whatever the number of landmarks.

Results: null, empty and blank texts score as a text without any word, the least score possible; repeated rows score alike. If the
sample has no row of one of the labels, every text scores 0. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import IS_SPACE, byte_pieces, labelled_sample, text_buffer, with_chars, words_of

#: Largest distance between the first and the last letter of a subsequence; weight per byte of its span.
SPAN, DECAY = 5, 0.6
#: Letters of a subsequence, five bits each, and the number of different ones.
LETTERS, SIZE = 4, 1 << 20
#: Bytes of a word; of longer ones windows are taken, every word of WINDOW - STRIDE + 1 letters is whole in one.
WORD_BYTES, WINDOW, STRIDE = 32, 10, 2
#: Landmarks, training rounds and regularisation of the support vector machine.
LANDMARKS, ROUNDS, COST = 512, 4, 16.0
#: Bounds of the training sample: toxic rows, clean rows, characters of a text.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1_000, 2_000, 20_000

_OFFSETS = [(a, b, c) for c in range(3, SPAN + 1) for b in range(2, c) for a in range(1, b)]


def _codes() -> np.ndarray:
    """Letters 1 to 26 whatever the case, bytes that continue a multi-byte character 27 to 31, all else 0: a gap."""
    out = np.zeros(256, np.uint16)
    for k in range(26):
        out[65 + k] = out[97 + k] = k + 1
    for b in range(0x80, 0xC0):
        out[b] = 27 + b % 5
    return out


CODE = _codes()


def _reach() -> np.ndarray:
    """What a word of each length can reach: root of the summed squares of the weights of its subsequences."""
    length = np.arange(WORD_BYTES + 1)
    total = sum(np.maximum(0, length - c) * DECAY ** (2 * (c + 1)) for *_, c in _OFFSETS)
    return np.sqrt(np.maximum(total, 1e-9))


REACH = _reach()


@dataclass
class Model:
    weight: np.ndarray  # per subsequence of four letters
    bias: float
    slope: float
    shift: float


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; spaced-out letters are one word, long words several windows."""
    return windowed(*joined_words(data, offsets))


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, however long; spaced-out letters are one word."""
    start, end, row = words_of(data, offsets, IS_SPACE)
    if not len(start):
        return start, end, row
    letter = (end - start == 1) & (CODE[data[start]] > 0)
    joins = letter[1:] & letter[:-1] & (row[1:] == row[:-1]) & (start[1:] - end[:-1] == 1)
    head = np.append(True, ~joins)
    start, row = start[head], row[head]
    end = end[np.append(~joins, True)]
    return start, end, row


def windowed(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than ``WORD_BYTES`` bytes as overlapping windows."""
    size = end - start
    parts = np.where(size > WORD_BYTES, -(-(size - WINDOW) // STRIDE) + 1, 1)
    if not len(parts) or parts.max() == 1:
        return start, end, row
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(parts > 1, parts)
    stop = np.repeat(end, parts)
    first = np.where(cut, np.minimum(np.repeat(start, parts) + nth * STRIDE, stop - WINDOW), np.repeat(start, parts))
    return first, np.where(cut, first + WINDOW, stop), np.repeat(row, parts)


def other_forms(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray):
    """(bytes, start, end, row) of the further forms of words that hold other characters than letters: letters alone, and runs of letters."""
    letter = CODE[data] > 0
    run = np.append(0, np.cumsum(letter))
    count = run[end] - run[start]
    mixed = np.flatnonzero((count < end - start) & (count >= LETTERS))
    if not len(mixed):
        return
    s, e, r = start[mixed], end[mixed], row[mixed]
    inside = np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange((e - s).sum())
    # runs of letters within the words; neighbouring words do not run together, as white space stands between them
    own = np.zeros(len(data) + 1, bool)
    own[inside] = letter[inside]
    edge = np.flatnonzero(np.diff(np.append(False, own).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    word = np.searchsorted(s, a, "right") - 1
    keep = b - a >= LETTERS
    if keep.any():
        yield data, *windowed(a[keep], b[keep], r[word[keep]])
    broken = np.flatnonzero(np.bincount(word, minlength=len(s)) > 1)  # with one run, its letters alone are that run
    if len(broken):
        s, e, r, size = s[broken], e[broken], r[broken], count[mixed][broken]
        inside = np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange((e - s).sum())
        stop = np.cumsum(size)
        yield data[inside[letter[inside]]], *windowed(stop - size, stop, r)


def bytes_left(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes from each place to the end of its word, 0 outside of words."""
    size = end - start
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    left = np.zeros(n, np.uint8)
    left[inside] = np.repeat(end, size) - inside
    return left


def word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subsequences, divided by its reach."""
    n = len(data)
    code = np.zeros(n + SPAN, np.uint32)
    code[:n] = CODE[data]
    left = bytes_left(n, start, end)
    first, second, third = code[:n] << np.uint32(15), code << np.uint32(10), code << np.uint32(5)
    total = np.zeros(n, np.float32)
    for a, b, c in _OFFSETS:
        four = first + second[a:a + n] + third[b:b + n] + code[c:c + n]
        total += np.take(weight, four) * ((left > c) * np.float32(DECAY ** (c + 1)))
    run = np.zeros(n + 1)
    np.cumsum(total, out=run[1:])
    return (run[end] - run[start]) / REACH[end - start]


def word_sums_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """As ``word_sums`` for words that may overlap: each counts within its own bounds."""
    code = np.append(CODE[data].astype(np.uint32), np.zeros(SPAN + WORD_BYTES, np.uint32))
    size = end - start
    at = np.minimum(start[:, None] + np.arange(int(size.max()))[None, :], len(data))
    left = size[:, None] - np.arange(at.shape[1])[None, :]
    total = np.zeros(len(start), np.float32)
    for a, b, c in _OFFSETS:
        four = (code[at] << np.uint32(15)) + (code[at + a] << np.uint32(10)) + (code[at + b] << np.uint32(5)) + code[at + c]
        total += (np.take(weight, four) * (left > c)).sum(axis=1) * np.float32(DECAY ** (c + 1))
    return total / REACH[size]


def word_scores(texts: pa.Array, model: Model):
    """(row, score, word start, word end, bytes) per stretch of the texts."""
    data, offsets = text_buffer(texts)
    for piece, off in byte_pieces(data, offsets):
        start, end, row = joined_words(piece, off)
        if not len(start):
            continue
        short = end - start <= WORD_BYTES
        if short.any():
            a, b = start[short], end[short]
            yield row[short], word_sums(piece, a, b, model.weight) + model.bias, a, b, piece
        units = [(piece, *windowed(start[~short], end[~short], row[~short]))]
        spaced = np.flatnonzero((end - start > 1) & IS_SPACE[piece[np.minimum(start + 1, len(piece) - 1)]])
        if len(spaced):  # letters alone, without the spaces between them
            size = (end[spaced] - start[spaced] + 1) // 2
            stop = np.cumsum(size)
            letters = piece[np.repeat(start[spaced] - 2 * (stop - size), size) + 2 * np.arange(stop[-1])]
            units.append((letters, *windowed(stop - size, stop, row[spaced])))
        units += other_forms(piece, *words_of(piece, off, IS_SPACE))
        for letters, a, b, r in units:
            order = np.argsort(b - a, kind="stable")  # words of like length together
            for i in range(0, len(order), 8_192):
                at = order[i:i + 8_192]
                yield r[at], word_sums_of(letters, a[at], b[at], model.weight) + model.bias, a[at], b[at], letters


def decisions(texts: pa.Array, model: Model) -> np.ndarray:
    """The highest word score of each text; that of an empty word where there is none."""
    out = np.full(len(texts), model.bias - 1.0)
    for row, score, *_ in word_scores(texts, model):
        np.maximum.at(out, row, score)
    return out


def probabilities(d: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * d + model.shift, -30, 30)))


# ---- training -----------------------------------------------------------------------------------


def _subsequences(c: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all subsequences without a gap character, repeats included."""
    codes, weights = [], []
    for a, b, d in _OFFSETS:
        at = np.flatnonzero(left > d)
        letters = np.stack([c[at], c[at + a], c[at + b], c[at + d]])
        letters = letters[:, (letters > 0).all(axis=0)]
        codes.append(letters[0] << 15 | letters[1] << 10 | letters[2] << 5 | letters[3])
        weights.append(np.full(letters.shape[1], DECAY ** (d + 1)))
    return np.concatenate(codes), np.concatenate(weights)


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit kernel features (word, code, value) of the words, divided by each word's reach."""
    found = [_subsequences(CODE[np.frombuffer(w, np.uint8)].astype(np.int64), np.arange(len(w), 0, -1)) for w in words]
    sizes = [len(c) for c, _ in found]
    word = np.repeat(np.arange(len(words)), sizes)
    if not len(word):
        return word, np.zeros(0, np.int64), np.zeros(0)
    return word, np.concatenate([c for c, _ in found]), np.concatenate([v / REACH[len(w)] for (_, v), w in zip(found, words, strict=True)])


class _Landmarks:
    """Kernel values against a set of words."""

    def __init__(self, marks: list[bytes]) -> None:
        word, code, value = _features(marks)
        self.codes, at = np.unique(code, return_inverse=True)
        self.z = np.zeros((len(self.codes) + 1, len(marks)), np.float32)  # the last row stands for all other codes
        np.add.at(self.z, (at, word), value)

    def against(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.z.shape[1]), np.float32)
        for i in range(0, len(words), 40):  # a few words at once: their subsequences times the landmarks are held
            word, code, value = _features(words[i:i + 40])
            if len(word):
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                known = np.flatnonzero(self.codes[at] == code)
                if len(known):
                    w = word[known]
                    head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    out[i + w[head]] = np.add.reduceat(self.z[at[known]] * value[known, None].astype(np.float32), head, axis=0)
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        weight = np.zeros(SIZE, np.float32)
        weight[self.codes] = self.z[:-1] @ alpha
        return weight


def _presence(texts: pa.Array) -> np.ndarray:
    """In how many texts each subsequence occurs."""
    counts = np.zeros(SIZE, np.int64)
    data, offsets = text_buffer(texts)
    start, end, _ = cut_words(data, offsets)
    left, code = bytes_left(len(data), start, end), CODE[data].astype(np.int64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        counts[np.unique(_subsequences(code[a:b], left[a:b])[0])] += 1
    return counts


def _words(texts: pa.Array) -> dict[bytes, int]:
    """In how many texts each word occurs, case and outer punctuation aside."""
    out: dict[bytes, int] = {}
    for t in texts.to_pylist():
        for w in {w.strip(b".,;:!?\"'()") for w in t.encode().lower().split()}:
            if LETTERS <= len(w) <= WORD_BYTES:
                out[w] = out.get(w, 0) + 1
    return out


def _varied(word: bytes, k: int) -> list[bytes]:
    """The word with a character inserted, and with one doubled."""
    cut = 1 + k % max(1, len(word) - 1)
    out = [word[:cut] + b"*.-_"[k % 4:k % 4 + 1] + word[cut:], word[:cut] + word[cut - 1:cut] + word[cut:]]
    return [w for w in out if len(w) <= WORD_BYTES]


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + xs.T @ x[inside], xs.T @ y[inside])
        done = np.allclose(new, w, atol=1e-6)
        w = new if done or _ < 8 else (new + w) / 2
        if done:
            break
    return w


def _some(words: list[bytes], most: int, rng) -> list[bytes]:
    return words if len(words) <= most else [words[i] for i in np.sort(rng.choice(len(words), most, replace=False))]


def _top_words(texts: pa.Array, model: Model, k: int) -> list[list[tuple[float, bytes]]]:
    out: list[dict] = [{} for _ in range(len(texts))]
    for row, score, start, end, piece in word_scores(texts, model):
        order = np.lexsort((-score, row))
        r = row[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        raw = piece.tobytes()
        for i in order[rank < 3 * k]:
            out[row[i]][raw[start[i]:end[i]].lower()] = float(score[i])
    return [sorted(((s, w) for w, s in x.items()), reverse=True)[:k] for x in out]


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, cost: float = COST) -> Model:
    y = np.array(toxic, int)
    model = Model(np.zeros(SIZE, np.float32), 0.0, 0.0, -40.0)
    if not (y == 1).any() or not (y == 0).any():
        return model
    pos = pa.array([t for t, v in zip(texts, toxic, strict=True) if v == 1], pa.string())
    neg = pa.array([t for t, v in zip(texts, toxic, strict=True) if v != 1], pa.string())
    rng = np.random.default_rng(0)
    apart = (pos, neg)  # texts that the curve from scores to probabilities is fitted on
    if min(len(pos), len(neg)) >= 8:  # a quarter of the texts of each label is kept out of the machine for it
        fourth = [rng.permutation(len(x)) % 4 == 3 for x in apart]
        apart = tuple(x.filter(pa.array(m)) for x, m in zip(apart, fourth, strict=True))
        pos, neg = (x.filter(pa.array(~m)) for x, m in zip((pos, neg), fourth, strict=True))
    p, n = _presence(pos), _presence(neg)
    odds = np.log((p + 0.5) / (len(pos) + 1)) - np.log((n + 0.5) / (len(neg) + 1))
    model.weight = np.where(p >= min(3, len(pos)), np.maximum(odds, 0), 0).astype(np.float32)
    # words of many toxic texts and no or hardly any clean one are toxic from the start
    often, seldom, scale = _words(pos), _words(neg), (len(neg) + 1) / (len(pos) + 1)
    known = {w for w, c in often.items() if c >= 3 and c * scale > 8 * (seldom.get(w, 0) + 2 * scale ** 0.5)}
    hard: dict[bytes, None] = {}
    for k in range(rounds):
        good = set(known)
        for x in _top_words(pos, model, 3):
            bare = [w.strip(b".,;:!?\"'()") for _, w in x]
            # once trained, every word beyond the margin counts; until then, without known words, the best of each text
            good |= {w for (s, _), w in zip(x, bare, strict=True) if k and s > 1} if known or k else set(bare[:1])
        hard |= {w: None for x in _top_words(neg, model, 2) for _, w in x}
        ranked = sorted((w for w in good if w not in seldom and len(w) >= LETTERS), key=lambda w: (-often.get(w, 0), w))
        good = ranked[:500] + _some(ranked[500:], 1500, rng)
        bad = _some(sorted(w for w in hard if w.strip(b".,;:!?") not in known), 4000, rng)
        if not good or not bad:
            break
        weight = [float(often.get(w, 1)) ** 0.5 for w in good]
        varied = [(v, weight[i] / 2) for i, w in enumerate(good[:300]) for v in _varied(w, i) if v not in seldom]
        half = min(len(good), landmarks // 2)
        marks = good[:half] + [w for w, _ in _some(varied, landmarks // 8, rng)] + _some(bad, landmarks // 4, rng)
        marks += _some(good[half:], landmarks - len(marks), rng)
        kernel = _Landmarks(marks)
        value, vector = np.linalg.eigh(kernel.against(marks).astype(float))
        keep = value > 1e-6 * value[-1]
        whiten = vector[:, keep] / np.sqrt(value[keep])  # Nyström map: kernel values against the landmarks times this
        words = [*good, *(v for v, _ in varied), *bad]
        x = kernel.against(words) @ whiten
        label = np.where(np.arange(len(words)) < len(words) - len(bad), 1.0, -1.0)
        heavy = np.array(weight + [v for _, v in varied])
        w = _newton(x, label, cost * np.append(heavy / heavy.mean() * max(1.0, len(bad) / len(heavy)), np.ones(len(bad))))
        model.weight = kernel.folded(whiten @ w[:-1])  # the sum over landmarks, folded into the explicit features
        model.bias = float(w[-1])
    d = np.concatenate([decisions(x, model) for x in apart])
    n1, n0 = map(len, apart)
    target = np.array([(n1 + 1) / (n1 + 2)] * n1 + [1 / (n0 + 2)] * n0)
    share = np.where(np.arange(n1 + n0) < n1, 0.5 / n1, 0.5 / n0) * (n1 + n0)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(ab[0] * d + ab[1], -30, 30)))
        g = np.array([(share * (q - target) * d).sum(), (share * (q - target)).sum()]) + 1e-3 * ab
        v = share * q * (1 - q) + 1e-9
        h = np.array([[(v * d * d).sum(), (v * d).sum()], [(v * d).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - step / max(1.0, np.abs(step).max() / 2)
    model.slope, model.shift = float(ab[0]), float(ab[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
        max_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows (doc_id, toxic) given."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    rows, _ = labelled_sample(docs, with_chars(docs, known), "toxic", {1: toxic_rows, 0: clean_rows}, max_chars)
    return train([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the data

    def run(batches):
        for batch in batches:
            s = probabilities(decisions(batch.column("text"), held.value), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all columns: only the texts go to the scoring function and back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = probabilities(decisions(batch.column(batch.schema.get_field_index("text")), held.value), held.value)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
