"""Search against all scores by the definition, whatever the segments, windows and share of short lists."""

import math
import re

import numpy as np

from airsignal.llm import search as S
from airsignal.llm.common import Powers
from tests.llm.conftest import EDGES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every item."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n, length = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in own.items():
        scored = []
        for i, t in found:
            m = 100 - 90 + (90 * len(t) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(n=700, words=60, seed=1):
    """Zipf-like words, so that some lists hold nearly all documents and many hold a few; ties and repeats among them."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    texts = [" ".join(f"w{x}" for x in rng.choice(words, rng.integers(1, 30), p=p / p.sum())) for _ in range(n)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(n), texts)]
    return docs + docs[:40] + [(n + k, docs[3][1]) for k in range(30)]


def test_against_all_scores(spark, monkeypatch):
    docs = corpus()
    items = [(k, " ".join(f"w{x}" for x in range(k, 60, 1 + k % 7))) for k in range(25)]
    want = brute(docs, items)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rows(S.search(d, q)) == want
    for size, window, short, block in ((64, 8, 0.0, 10 ** 6), (50, 16, 0.5, 200), (1000, 4, 10.0, 10 ** 6)):
        for name, v in (("SEGMENT_DOCS", size), ("WINDOW", window), ("SHORT", short)):
            monkeypatch.setattr(S, name, v)
        assert rows(S.search(d, q, block_terms=block)) == want


def test_windows_are_skipped(monkeypatch):
    """One rare word in one document of many: hardly any window is opened."""
    n = 20000
    row = {"docs": n, "words": n * 3, "term": [0, 1], "df": [n, 10], "sizes": np.full(n, 3, "<i8").tobytes(),
           "doc": np.append(np.arange(n), np.arange(10) * 7).astype("<i4").tobytes(), "tf": np.ones(n + 10, "<i8").tobytes()}
    lists = S._Lists(row, S.Plan([0], np.array([0, 2]), np.array([0, 1]), np.array([1, 9000]), n, n * 3))
    opened = []
    cut = S._cut
    monkeypatch.setattr(S, "_cut", lambda *a: opened.append(1) or cut(*a))
    doc, _ = S.best(lists, np.array([0, 1]), 10)
    assert sorted(doc.tolist()) == [7 * k for k in range(10)] and len(opened) <= 3


def test_edges(spark, edges, empty):
    items = [(1, "One plain TEXT, words: it."), (2, None), (3, ""), (4, "!!!"), (None, "secret alpha"), (5, "nowhere2be found9"), (6, "日本語 über"), (7, "One"), (7, "alpha xyz"), (8, "x" * 3000)]
    q = spark.createDataFrame([(i, t, 1, "d", 2.0) for i, t in items], "item_id long, text string, doc_id long, term string, score double")
    assert rows(S.search(edges, q)) == brute([(i, t) for i, t, _ in EDGES], items)
    assert S.search(empty, q).count() == 0 and S.search(edges, q.where("false")).count() == 0
    assert S.search(edges.where("doc_id in (3, 4)"), q).count() == 0


def test_terms_and_long_rows(monkeypatch):
    text = "Aé.b9 ß_Z\x7f日本語-" + "q" * 50 + " a " * 40 + "A" * 300
    assert [t.decode() for t in S.terms_of(text)] == terms(text)
    own = S.term_table({t.encode() for t in {*terms(text), "zz", "q" * 49}})
    raw = np.frombuffer(text.encode() * 3, np.uint8)
    monkeypatch.setattr(S, "SLICE_BYTES", 32)
    total, count = 0, {}
    for _, piece, off in S._pieces(raw, np.array([0, len(raw)])):
        n, _, t = S.occurrences(piece, off, own, Powers())
        total += int(n.sum())
        for x in t.tolist():
            count[own.terms[x].decode()] = count.get(own.terms[x].decode(), 0) + 1
    want = terms(text * 3)
    assert total == len(want) and count == {w: want.count(w) for w in set(want) & {t.decode() for t in own.terms}}


def test_terms_that_share_a_hash(monkeypatch):
    """Equal hashes do not make equal terms: bytes decide."""
    monkeypatch.setattr(S, "range_hashes", lambda d, a, b, p: np.zeros(len(a), np.uint64))
    own = S.term_table({b"ab", b"cd", b"abc", b"x"})
    data = np.frombuffer(b"cd abc zz x ab abc", np.uint8)
    n, _, term = S.occurrences(data, np.array([0, len(data)]), own, Powers())
    assert n.tolist() == [6] and [own.terms[t] for t in term] == [b"cd", b"abc", b"x", b"ab", b"abc"]


def test_weights():
    assert S.weights(10, np.array([0, 1, 10])).tolist() == [math.floor(1000 * math.log(22)), math.floor(1000 * math.log(22 / 3)), math.floor(1000 * math.log(22 / 21))]
