"""SimHash: fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from airsignal.llm import simhash
from airsignal.llm.common import table
from tests.conftest import SF
from tests.llm.conftest import EDGES


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def classes(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def near_pairs(fps, bits=3):
    f = np.array(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= bits, 1))
    return list(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_components(spark, edges, source):
    docs = table(spark, SF, "documents") if source == "documents" else edges
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    group = classes(len(rows), near_pairs(fps))
    smallest = {}
    for g, r in zip(group, rows):
        if r.doc_id is not None:
            smallest[g] = min(smallest.get(g, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(smallest.get(g))) for r, f, g in zip(rows, fps, group))
    for node_rows in (simhash.NODE_ROWS, 20):  # also with nodes that are split into finer ones
        got = simhash.near_duplicates(docs, node_rows=node_rows).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("n,nodes", [(1, 1), (60, 1), (500, 7), (2500, 3), (3000, 700)])
def test_tree_finds_every_link(n, nodes):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**64, 40, dtype=np.uint64)[rng.integers(0, 40, n)]
    for _ in range(6):
        fps ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    node = np.sort(rng.integers(0, nodes, n))
    order = np.lexsort((simhash.gray_rank(fps), node))
    fps = fps[order]
    found = [p for i, j in simhash.Tree(fps, node).links(node, 3) for p in zip(i.tolist(), j.tolist())]
    near = [(i, j) for i, j in near_pairs(fps) if node[i] == node[j]]
    assert set(found) <= set(near)
    assert classes(n, found) == classes(n, near)
    assert len(found) <= n


def test_stage_keeps_one_of_each(edges, empty):
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert len(ids) < len(EDGES) and 7 not in ids and {1, 6, 8} <= set(ids)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
