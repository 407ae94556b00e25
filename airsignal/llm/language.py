"""Language identification by string kernels.

Two texts are compared by the character n-grams (one to four letters of a word, blended) that both contain, present or not, whatever
their number: the inner product of two presence vectors over hashed n-grams, divided by their lengths.
Landmarks are texts of the sample; kernel values against them are whitened (Nyström), and a kernel ridge
regression per language, one against the rest, is solved in that space. Texts are scored in batches by two matrix
products: presence times landmarks, and kernel values times coefficients.

Whole texts count, cut into stretches only for memory; a training text is also shown by its first words alone, so that
short texts are known too. Letters are lower-cased in ASCII; digits and punctuation separate words.

Results: a null text, or one without any letter, is ``und`` with score 0; without learned languages all are
``und``. Repeated rows get equal results; ties take the first language in alphabetical order. Columns other than doc_id,
text and (for training) lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import byte_pieces, labelled_sample, text_buffer

#: Hashed n-grams and the longest n-gram in bytes.
GRAMS, LONGEST = 1 << 15, 4
#: Landmarks, ridge, and sharpness of the scores.
LANDMARKS, RIDGE, SHARP = 256, 1e-3, 6.0
#: Bounds of the training sample: rows of a language and of all, characters of a text; words of the short copies.
LANG_ROWS, SAMPLE_ROWS, SAMPLE_CHARS, SHORT_WORDS = 750, 3_000, 10_000, 8
#: Rows scored at once.
ROWS = 256

def _fold() -> np.ndarray:
    """Letters and bytes of multi-byte characters stand, capitals become small, all else separates words."""
    out = np.zeros(256, np.uint32)
    for b in range(97, 123):
        out[b] = out[b - 32] = b
    out[128:] = np.arange(128, 256)
    return out


FOLD = _fold()


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return text is not None and any(map(str.isalpha, text))


def presence(texts: pa.Array, grams: int = GRAMS) -> np.ndarray:
    """1 where a text contains an n-gram of the bucket, rows scaled to length 1."""
    data, offsets = text_buffer(texts)
    out = np.zeros((len(texts), grams), np.float32)
    shift = np.uint32(32 - int(grams - 1).bit_length())
    for piece, off in byte_pieces(data, offsets):
        n, c = len(piece), np.append(FOLD[piece], np.zeros(LONGEST, np.uint32))
        size = np.diff(off)
        row = np.repeat(np.arange(len(texts)) * grams, size)
        left = np.repeat(off[1:], size) - np.arange(n)  # bytes to the end of the text
        code, inside, starts = np.zeros(n, np.uint32), np.ones(n, bool), np.ones(n, bool)
        for k in range(LONGEST):
            inside &= (c[k:k + n] > 0) & (left > k)  # a gram ends with its word and is padded there
            code = code * np.uint32(257) + c[k:k + n] * inside
            if k < 2:
                starts &= inside
            ok = np.flatnonzero(starts)
            h = ((code[ok] + np.uint32(k)) * np.uint32(2654435761)) >> shift
            out.reshape(-1)[row[ok] + h] = 1
    out /= np.maximum(np.sqrt(out.sum(axis=1, keepdims=True)), 1)
    return out


def kernel_values(texts: pa.Array, landmarks: np.ndarray) -> np.ndarray:
    """Presence of each text times the landmarks (buckets x landmarks): one matrix product."""
    return presence(texts, len(landmarks)) @ landmarks


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # grams x landmarks
    coef: np.ndarray  # landmarks x languages


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    known = sorted(set(langs))
    if not known:
        return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros((0, 0), np.float32))
    short = [" ".join(t.split()[:SHORT_WORDS]) for t in texts]
    y = np.where(np.array(langs * 2)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    # landmarks of all languages in turn, whole texts first
    place = np.zeros(len(langs), int)
    seen: dict[str, int] = {}
    for i, v in enumerate(langs):
        place[i] = seen[v] = seen.get(v, -1) + 1
    marks = np.lexsort((langs, place))[:landmarks]
    z = np.ascontiguousarray(presence(pa.array([texts[i] for i in marks], pa.string())).T)
    value, vector = np.linalg.eigh((z.T @ z).astype(float))
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    whole = texts + short
    kernel = np.vstack([kernel_values(pa.array(whole[i:i + ROWS], pa.string()), z) for i in range(0, len(whole), ROWS)])
    f = kernel.astype(float) @ whiten  # Nyström features of the sample
    per_lang = 1.0 / np.array([langs.count(v) for v in known])
    w = per_lang[[known.index(v) for v in langs] * 2]
    w = w / w.mean()
    f1 = np.hstack([f, np.ones((len(f), 1))])
    solved = np.linalg.solve(f1.T @ (f1 * w[:, None]) + ridge * len(f) * np.eye(f1.shape[1]), f1.T @ (y * w[:, None]))
    coef = np.vstack([whiten @ solved[:-1], solved[-1:]])
    return Model(known, z, coef.astype(np.float32))


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    if not model.langs or not n:
        return ["und"] * n, np.zeros(n)
    kernel = kernel_values(texts, model.landmarks)
    z = kernel @ model.coef[:-1] + model.coef[-1]
    p = np.exp(SHARP * (z - z.max(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    letters = list(map(has_letter, texts.to_pylist()))
    return [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(n), best], 0.0)


def fit(docs: DataFrame, per_lang: int = LANG_ROWS, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the rows (doc_id, text, lang) given, those with a lang: up to ``per_lang`` of every language, so that a seldom one is learned too.

    With more than ``rows`` / ``per_lang`` languages each has an equal part of ``rows``, 20 at least.
    """
    known = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.char_length("text").alias("chars"))
    sample, _ = labelled_sample(docs, known, "lang", per_lang, max_chars, rows)
    sample = [r for r in sample if has_letter(r.text)]
    return train([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS x GRAMS numbers at most

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                langs, score = predict(part.column("text"), held.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))
