"""Winnowing against a direct implementation, its guarantee, and the comparison of neighbours."""

import hashlib
import random

import numpy as np
import pytest

from airsignal.llm import winnow
from airsignal.llm.common import BASE, Powers, mix
from tests.llm.conftest import EDGES

POWERS = Powers()


def brute(text, gram, window):
    if not text:
        return []
    gram, hashes = min(gram, len(text)), []
    for i in range(len(text) - gram + 1):
        x = sum((ord(text[i + j]) + 1) * pow(int(BASE), j, 1 << 64) for j in range(gram)) % (1 << 64)
        hashes.append(int(mix(np.array([x], np.uint64))[0]))
    window, out = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        ranks = [h >> 20 for h in hashes[i:i + window]]
        j = i + max(k for k in range(window) if ranks[k] == min(ranks))
        if not out or out[-1][1] != j:
            out.append((hashes[j], j))
    return out


@pytest.mark.parametrize("stretch", [winnow.STRETCH, 40])
def test_marks(stretch, monkeypatch):
    monkeypatch.setattr(winnow, "STRETCH", stretch)
    rnd = random.Random(0)
    for k in range(120):
        text = "".join(rnd.choice("ab é" if k % 2 else "a") for _ in range(rnd.choice([0, 1, 3, 5, 20, 200])))
        for gram, window in ((5, 4), (3, 8), (16, 48)):
            h, p = winnow.marks(text, POWERS, gram, window)
            assert list(zip(h.tolist(), p.tolist())) == brute(text, gram, window)


def test_guarantee():
    """A shared passage of gram + window - 1 characters has a shared mark at the passage's offset."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        shared, a, b = word(winnow.GRAM + winnow.WINDOW - 1), word(rnd.randint(0, 300)), word(rnd.randint(0, 300))
        ha, pa_ = winnow.marks(a + shared + word(50), POWERS)
        hb, pb = winnow.marks(b + shared + word(70), POWERS)
        inside = {(h, p - len(a)) for h, p in zip(ha.tolist(), pa_.tolist())} & {(h, p - len(b)) for h, p in zip(hb.tolist(), pb.tolist())}
        assert inside


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        m, e, n = (winnow.marks(x, POWERS) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.digest(*m), winnow.digest(*e),
                    winnow.likeness(m[0], e[0]), winnow.likeness(m[0], n[0]), len(m[0]), len(e[0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_neighbours(spark, edges, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((tuple(r) for r in winnow.edited_likeness(edges).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected([(i, t) for i, t, _ in EDGES])


def test_single_row_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")
    r = winnow.edited_likeness(one).collect()
    assert [tuple(x) for x in r] == expected([(1, "abcdefghi")])
    assert winnow.edited_likeness(empty).count() == 0 and winnow.fingerprints(empty).count() == 0


def test_fingerprints(edges):
    got = {(r.doc_id, r.n_chars, tuple(r.positions)) for r in winnow.fingerprints(edges).collect()}
    assert got == {(i, len(t or ""), tuple(winnow.marks(t or "", POWERS)[1].tolist())) for i, t, _ in EDGES}
