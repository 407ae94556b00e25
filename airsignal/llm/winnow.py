"""Document fingerprints by winnowing.

Rolling 64-bit hashes of all grams of ``gram`` code points; of each window of ``window`` hashes the smallest is
chosen, the rightmost one on ties, and kept with its position. Guarantees: two texts that share a passage of at
least ``gram + window - 1`` code points share a chosen hash, at positions that differ by the
passage's offset; no shared passage shorter than ``gram`` is reported (but for hash collisions).

Texts shorter than ``gram`` have one mark, the hash of the whole text at position 0; empty and null texts have none.
A text with fewer hashes than a window has one, its smallest. Two empty fingerprints have likeness 1, an empty
and another one 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import Powers, mix, saved, shuffle_partitions

#: Code points of a gram and hashes of a window.
GRAM, WINDOW = 8, 16
#: Code points hashed at once; longer texts are done in stretches that overlap by a gram and a window.
STRETCH = 1 << 18
#: Rows of a batch that are worked on at once.
CHUNK = 64


def marks(text: str, powers: Powers, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(gram, len(points))
    hashes, places, at = [], [], 0
    total = len(points) - gram + 1
    while True:
        part = points[at:at + STRETCH + gram + window - 2]
        h = _gram_hashes(part, gram, powers)
        pos = _chosen(h, min(window, total))
        hashes.append(h[pos])
        places.append(pos + at)
        at += STRETCH
        if at + window - 1 >= total:
            break
    h, p = np.concatenate(hashes), np.concatenate(places)
    keep = np.ones(len(p), bool)
    keep[1:] = p[1:] > np.maximum.accumulate(p)[:-1]  # the overlap of two stretches chooses alike
    return h[keep], p[keep]


def _gram_hashes(points: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    up, down = powers.upto(len(points) + 1)
    run = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:len(points)], out=run[1:])
    return mix((run[gram:] - run[:-gram]) * down[:len(points) - gram + 1])


def _chosen(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, rightmost on ties: running minima from both ends of blocks."""
    n, local = len(h), np.arange(len(h), dtype=np.uint64)
    # 44 bits of hash order, then the place counted backwards (20 bits are enough for a stretch): smaller is further right
    key = (h & np.uint64(0xFFFFFFFFFFF00000)) | (np.uint64(0xFFFFF) - local)
    pad = -n % window
    blocks = np.append(key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # from i to the end of its block
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)  # from the start of its block to i
    least = np.minimum(ahead[:n - window + 1], behind[window - 1:n])
    pos = (np.uint64(0xFFFFF) - (least & np.uint64(0xFFFFF))).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = pos[1:] != pos[:-1]
    return pos[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of chosen hashes (Jaccard)."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """Short form of a fingerprint: sha256 of its hashes and positions."""
    return hashlib.sha256(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes (array<long>) and positions (array<long>, in code points) of every row."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [marks(t, powers, gram, window) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                     pa.array([p for _, p in found], pa.list_(pa.int64()))],
                    names=["doc_id", "n_chars", "hashes", "positions"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>"))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_marks long, n_edited_marks long")


class _Row:
    """A text with its marks."""

    __slots__ = ("doc_id", "hashes", "places", "text")

    def __init__(self, doc_id, text: str, powers: Powers, gram: int, window: int) -> None:
        self.doc_id, self.text = doc_id, text
        self.hashes, self.places = marks(text, powers, gram, window)

    def compared(self, after: "_Row", powers: Powers, gram: int, window: int) -> tuple:
        cut = len(self.text) // 3
        edited = self.text[:len(self.text) - cut] + after.text[:cut]
        h, p = marks(edited, powers, gram, window)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(),
                digest(self.hashes, self.places), digest(h, p), likeness(self.hashes, h),
                likeness(self.hashes, after.hashes), len(self.hashes), len(h))


def edited_likeness(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Compare each text with itself after an edit and with the next document.

    Documents stand in descending doc_id (null ids last; rows of one id by a hash of the text, then by text); after the
    last comes the first. The texts are dealt once into ranges of that order; a task reads its range in order and holds two
    texts. Only the first and last text of each range meet the neighbouring range in a second, small
    step. One document alone is its own next.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.float64() if f.endswith("double") else pa.string() for f in RESULT.split(", ")]

    def out(results: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Finished rows, then boundary rows: (part, kind, doc_id, text)."""
        cols = [pa.array([r[k] for r in results] + [e[2] if not k else None for e in edges], t) for k, t in enumerate(types)]
        blank = [None] * len(results)
        cols += [pa.array(blank + [e[0] for e in edges], pa.int32()), pa.array(blank + [e[1] for e in edges], pa.string()),
                 pa.array(blank + [e[3] for e in edges], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "part", "kind", "text"])

    def inside(batches):
        powers, before = Powers(), None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                results, edges = [], []
                piece = batch.slice(at, CHUNK)
                for doc_id, text, part in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                    row = _Row(doc_id, text, powers, gram, window)
                    if before is None:
                        edges.append((part, "first", doc_id, text))
                    else:
                        results.append(before.compared(row, powers, gram, window))
                    before = row
                yield out(results, edges)
            pa.default_memory_pool().release_unused()  # a worker serves many tasks
        if before is not None:
            yield out([], [(part, "last", before.doc_id, before.text)])

    done = saved(dealt.mapInArrow(inside, f"{RESULT}, part int, kind string, text string"), "winnow")
    firsts = done.where("kind = 'first'").select("part", F.col("text").alias("next_text"))
    lasts = done.where("kind = 'last'").select("part", "doc_id", "text")
    # one row per range that holds rows: number them and join each to the range after it
    parts = [r.part for r in firsts.select("part").orderBy("part").collect()]  # range numbers only
    after = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, after int")
    pairs = (lasts.join(F.broadcast(after), "part")
             .join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next_text"))

    def across(batches):
        powers = Powers()
        for batch in batches:
            results = []
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                a = _Row(doc_id, text, powers, gram, window)
                results.append(a.compared(_Row(None, following, powers, gram, window), powers, gram, window))
            yield out(results, []).select(names)

    return done.where("kind is null").select(*names).unionByName(pairs.mapInArrow(across, RESULT))
