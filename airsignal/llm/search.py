"""Ranked lexical search, hybrid term-at-a-time and document-at-a-time.

Index: one pass over whole texts, for the terms of a block of items. Each task packs its documents, in the order of doc_id, into
segments of up to ``SEGMENT_DOCS`` documents: ids, lengths, and for each term of the items the list of documents that hold it with the
number of occurrences. Segments are written once to shared storage; totals over them give the weights.

Search: each segment is searched for all items. An item's lists are taken by length. The short ones, ``SHORT`` x the segment's
documents together, are merged term at a time into accumulators (document, summed score), which then act as one more list with a known bound per
window of ``WINDOW`` documents. The long ones are walked document at a time together with it: a window whose bounds (largest impact of
each list in it, times its weight, plus the largest accumulator) do not reach the item's tenth best score so far is skipped in all lists at
once; within the others the lists come by falling bound, and stop where nothing that is left can reach the tenth score. Each
segment returns its best documents of each item, and a window over these few rows ranks them. Everything is in integers but the weights' logarithm.

Terms are the maximal runs of bytes 0-9, A-Z, a-z and 0x80-0xFF of the UTF-8 text, that is of ASCII letters and digits and of all
characters beyond ASCII, with A-Z lower-cased. They are found by 64-bit hashes and compared byte by byte.

Results: null and empty texts have no term and are no documents; items without a term, or whose terms occur nowhere, have no row.
Every row of the documents counts as a document of its own, repeated ones too; a null doc_id stands after all others. Rows of one item_id are
one item with the terms of all of them. An empty table gives an empty result. Columns other than ids and texts are ignored.
Items are searched in blocks of about ``BLOCK_TERMS`` terms, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsignal.llm.common import SLICE_BYTES, Powers, range_hashes, row_slices, saved, text_buffer, words_of

#: Terms of the items of one block, documents and postings of a segment, documents of a window.
BLOCK_TERMS, SEGMENT_DOCS, SEGMENT_POSTINGS, WINDOW = 200_000, 16_384, 2_000_000, 256
#: Postings merged term at a time, as a share of the segment's documents.
SHORT = 0.25


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


SEPARATES = _separators()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, in order, repeats included."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return FOLD[np.where(SEPARATES[raw], 32, raw)].tobytes().split()


# ---- index ----------------------------------------------------------------------------------------


@dataclass
class Terms:
    """The terms sought, by the order of their hashes."""

    terms: list[bytes]
    hashes: np.ndarray  # sorted
    bits: np.ndarray  # which leading 16 bits occur among them
    data: np.ndarray  # the terms one after another
    start: np.ndarray
    size: np.ndarray
    places: dict[bytes, int]


def term_table(terms: set[bytes]) -> Terms:
    listed = sorted(terms)
    data = np.frombuffer(b"".join(listed), np.uint8)
    size = np.array([len(t) for t in listed], np.int64)
    start = np.cumsum(size) - size
    h = range_hashes(data, start, start + size, Powers()) if len(listed) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    bits = np.zeros(1 << 16, bool)
    bits[(h >> np.uint64(48)).astype(np.int64)] = True
    return Terms([listed[k] for k in order], h[order], bits, data, start[order], size[order], {listed[k]: p for p, k in enumerate(order.tolist())})


def _same(data: np.ndarray, start: np.ndarray, term: np.ndarray, own: Terms) -> np.ndarray:
    """Whether each word of the term's length is the term, byte by byte."""
    out, size = np.ones(len(start), bool), own.size[term]
    for k in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > k) if k else slice(None)
        out[at] &= data[start[at] + k] == own.data[own.start[term[at]] + k]
    return out


def occurrences(data: np.ndarray, offsets: np.ndarray, own: Terms, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row; row and term of each occurrence of a term sought)."""
    start, end, row = words_of(data, offsets, SEPARATES)
    n = np.bincount(row, minlength=len(offsets) - 1)
    if not len(own.hashes) or not len(start):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = FOLD[data]
    h = range_hashes(low, start, end, powers)
    at = np.flatnonzero(own.bits[(h >> np.uint64(48)).astype(np.int64)])
    found = np.searchsorted(own.hashes, h[at])
    last = len(own.hashes) - 1
    ok = (found <= last) & (own.hashes[np.minimum(found, last)] == h[at])
    at, found = at[ok], found[ok]
    # terms that share a hash stand side by side: the word is the one of them that has its bytes
    term = np.full(len(at), -1)
    rest = np.arange(len(at))
    while len(rest):
        t = found[rest]
        sized = own.size[t] == (end - start)[at[rest]]
        good = np.zeros(len(rest), bool)
        good[sized] = _same(low, start[at[rest[sized]]], t[sized], own)
        term[rest[good]] = t[good]
        rest = rest[~good & (t < last)]
        found[rest] += 1
        rest = rest[own.hashes[found[rest]] == h[at[rest]]]
    hit = term >= 0
    return n, row[at[hit]], term[hit]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, bytes, offsets): whole rows, a long row cut where a word has ended; a word longer than a slice stays in one piece."""
    for i, j in row_slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * SLICE_BYTES:
            yield i, data[a:b], offsets[i:j + 1] - a
            continue
        while a < b:
            end = min(b, a + SLICE_BYTES)
            if end < b:
                gap = np.flatnonzero(SEPARATES[data[a:end]])
                if len(gap):
                    end = a + int(gap[-1]) + 1
                else:
                    while end < b:
                        gap = np.flatnonzero(SEPARATES[data[end:end + SLICE_BYTES]])
                        end = end + int(gap[0]) + 1 if len(gap) else min(b, end + SLICE_BYTES)
                        if len(gap):
                            break
            yield i, data[a:end], np.array([0, end - a])
            a = end


class _Segment:
    """Documents gathered by a task until they make a segment."""

    def __init__(self) -> None:
        self.ids, self.known, self.sizes, self.rows, self.terms, self.counts, self.postings = [], [], [], [], [], [], 0
        self.docs = 0

    def add(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.ids.append(ids)
        self.known.append(known)
        self.sizes.append(n)
        self.rows.append(row + self.docs)
        self.terms.append(term)
        self.counts.append(count)
        self.docs += len(ids)
        self.postings += len(row)

    def full(self) -> bool:
        return self.docs >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def packed(self) -> pa.RecordBatch:
        ids, known, n = (np.concatenate(x) for x in (self.ids, self.known, self.sizes))
        row, term, count = (np.concatenate(x) for x in (self.rows, self.terms, self.counts))
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[row]
        by = np.lexsort((doc, term))
        listed, first = np.unique(term[by], return_index=True)
        sizes = np.diff(np.append(first, len(by)))
        raw = lambda v, kind: pa.array([v.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
            pa.array([listed.tolist()], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32())),
            raw(ids[order], "<i8"), raw(known[order], "u1"), raw(n[order], "<i8"), raw(doc[by], "<i4"), raw(count[by], "<i8")],
            names=["docs", "words", "term", "df", "ids", "known", "sizes", "doc", "tf"])


SEGMENT = "docs long, words long, term array<int>, df array<int>, ids binary, known binary, sizes binary, doc binary, tf binary"


def build_index(docs: DataFrame, own: Terms, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all documents with at least one term, written and read back."""
    held = docs.sparkSession.sparkContext.broadcast(own)  # the terms of a block of items

    def run(batches):
        own, powers, segment = held.value, Powers(), _Segment()
        for batch in batches:
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data, offsets = text_buffer(part.column("text"))
                n = np.zeros(part.num_rows, np.int64)
                keys, counts = [], []
                for first, piece, off in _pieces(data, offsets):
                    size, row, term = occurrences(piece, off, own, powers)
                    n[first:first + len(size)] += size
                    key, c = np.unique((row + first) * len(own.hashes) + term, return_counts=True)
                    keys.append(key)
                    counts.append(c)
                if not keys:
                    continue
                key, to = np.unique(np.concatenate(keys), return_inverse=True)  # pieces of one row together
                count = np.bincount(to, np.concatenate(counts), len(key)).astype(np.int64)
                has = n > 0
                place = np.cumsum(has) - 1
                row, term = (key // len(own.hashes), key % len(own.hashes)) if len(own.hashes) else (key, key)
                span = slice(at, at + part.num_rows)
                segment.add(ids[span][has], known[span][has], n[has], place[row], term, count)
                if segment.full():
                    yield segment.packed()
                    segment = _Segment()
        if segment.docs:
            yield segment.packed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return saved(rows.mapInArrow(run, SEGMENT), "segments")


# ---- search ---------------------------------------------------------------------------------------


@dataclass
class Plan:
    """What a task needs to search: the items' terms, their weights, and the totals of all documents."""

    items: list  # item ids
    first: np.ndarray  # places of each item's terms in ``terms``
    terms: np.ndarray
    weight: np.ndarray  # per term
    docs: int
    words: int


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class _Lists:
    """A segment's lists with their impacts, and their largest impact in each window."""

    def __init__(self, row: dict, plan: Plan) -> None:
        self.docs = row["docs"]
        n = np.frombuffer(row["sizes"], "<i8")
        m = 100 - 90 + (90 * n * plan.docs) // plan.words
        doc, tf = np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["tf"], "<i8")
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        ends = np.cumsum(row["df"])
        self.windows = -(-self.docs // WINDOW)
        self.lists = {}
        for t, a, b in zip(row["term"], np.append(0, ends[:-1]), ends):
            self.lists[int(t)] = (doc[a:b], impact[a:b] * plan.weight[t])
        self._bounds: dict[int, tuple] = {}

    def bounds(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(largest score of each window; where each window starts in the list)."""
        if term not in self._bounds:
            doc, score = self.lists[term]
            starts = np.searchsorted(doc, np.arange(self.windows + 1) * WINDOW)
            self._bounds[term] = (_window_max(doc, score, self.windows), starts)
        return self._bounds[term]


def _window_max(doc: np.ndarray, score: np.ndarray, windows: int) -> np.ndarray:
    out = np.zeros(windows, np.int64)
    if len(doc):
        w = doc // WINDOW
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[head]] = np.maximum.reduceat(score, head)
    return out


def best(lists: _Lists, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the segment) and scores that can be among the item's ``k`` best, at most ``k``, best first."""
    have = sorted((int(t) for t in terms if int(t) in lists.lists), key=lambda t: (len(lists.lists[t][0]), t))
    size, short = 0, []
    for t in have:
        size += len(lists.lists[t][0])
        if short and size > max(SHORT * lists.docs, 64):
            break
        short.append(t)
    long_ = have[len(short):]
    # term at a time: accumulators of the short lists, one list from here on
    doc = np.concatenate([lists.lists[t][0] for t in short]) if short else np.zeros(0, np.int32)
    acc_doc, to = np.unique(doc, return_inverse=True)
    acc = np.zeros(len(acc_doc), np.int64)
    if len(doc):
        np.add.at(acc, to, np.concatenate([lists.lists[t][1] for t in short]))
    top_doc, top = _cut(acc_doc.astype(np.int64), acc, k)  # scores so far: the k-th is a bound that the result cannot fall below
    floor = int(top[k - 1]) if len(top) == k else 1
    if not long_:
        return top_doc, top
    bounds = [lists.bounds(t) for t in long_]
    by = sorted(range(len(long_)), key=lambda j: -int(bounds[j][0].max()))
    acc_bound = _window_max(acc_doc, acc, lists.windows)
    acc_start = np.searchsorted(acc_doc, np.arange(lists.windows + 1) * WINDOW)
    ahead = np.cumsum(np.stack([bounds[j][0] for j in by])[::-1], axis=0)[::-1]  # bounds of the j-th list and those after it
    reach = acc_bound + ahead[0]
    top_doc, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # document at a time over all lists: windows in document order, those out of reach are skipped
    for w in np.flatnonzero(reach >= max(floor, 1)):
        if reach[w] < floor:
            continue
        base = int(w) * WINDOW
        score = np.zeros(WINDOW, np.int64)
        a, b = acc_start[w], acc_start[w + 1]
        score[acc_doc[a:b] - base] = acc[a:b]
        for place, j in enumerate(by):
            if int(score.max()) + ahead[place][w] < floor:  # nothing here can get there any more
                score = None
                break
            a, b = bounds[j][1][w], bounds[j][1][w + 1]
            if a < b:
                doc, s = lists.lists[long_[j]]
                score[doc[a:b] - base] += s[a:b]
        if score is None:
            continue
        at = np.flatnonzero(score >= max(floor, 1))
        if len(at):
            top_doc, top = _cut(np.append(top_doc, at + base), np.append(top, score[at]), k)
            if len(top) == k:
                floor = max(floor, int(top[-1]))
    return top_doc, top


def _cut(doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, equal scores by document."""
    if len(score) > 4 * k:  # the k-th best and all that equal it
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        doc, score = doc[keep], score[keep]
    order = np.lexsort((doc, -score))[:k]
    order = order[score[order] > 0]
    return doc[order], score[order]


def _searched(segments: DataFrame, plan: Plan, k: int) -> DataFrame:
    held = segments.sparkSession.sparkContext.broadcast(plan)  # a block of items

    def run(batches):
        plan = held.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                lists = _Lists(row, plan)
                ids, known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], "u1").astype(bool)
                item, doc, score = [], [], []
                for j in range(len(plan.items)):
                    d, s = best(lists, plan.terms[plan.first[j]:plan.first[j + 1]], k)
                    item += [j] * len(d)
                    doc.append(d)
                    score.append(s)
                if item:
                    d = np.concatenate(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids[d], pa.int64(), mask=~known[d]),
                                                      pa.array(np.concatenate(score), pa.int64())], names=["item", "doc_id", "score"])

    return segments.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    # (item, terms) pairs; the items are dealt into blocks by a hash, about ``block_terms`` pairs each
    found = saved(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(_item_terms, "item_id long, term binary").distinct(), "items")
    blocks = max(1, -(-found.count() // block_terms))
    parts = [_block(spark, docs, found.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _item_terms(batches):
    for batch in batches:
        for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(set(terms_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])


def _block(spark: SparkSession, docs: DataFrame, found: DataFrame, k: int) -> DataFrame | None:
    rows = found.collect()  # a block of items
    if not rows:
        return None
    own = term_table({bytes(r.term) for r in rows})
    segments = build_index(docs, own)
    total = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not total[0]:
        return None
    df = np.zeros(len(own.terms), np.int64)
    for r in (segments.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df"))).collect():  # a row per term of the block
        df[r.term] = r.df
    by: dict = {}
    for r in rows:
        by.setdefault(r.item_id, []).append(own.places[bytes(r.term)])
    listed = sorted(by, key=lambda i: (i is None, i or 0))
    sizes = [len(by[i]) for i in listed]
    plan = Plan(listed, np.append(0, np.cumsum(sizes)), np.array([t for i in listed for t in sorted(by[i])], np.int64),
                weights(int(total[0]), df), int(total[0]), int(total[1]))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = _searched(segments, plan, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(j, i) for j, i in enumerate(listed)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _oracle() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, tot GROUP BY term),
s AS (SELECT q.item_id, n.r, n.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * n.n * tot.nn) // tot.ll))))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = q.term JOIN n ON n.r = p.r, tot GROUP BY q.item_id, n.r, n.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM k WHERE place <= 10"""


ORACLE = _oracle()
