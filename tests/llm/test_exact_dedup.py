"""Exact deduplication against a dictionary, and the directory's splits."""

import hashlib
import re

import numpy as np
import pytest

from airsignal.llm import exact_dedup
from airsignal.llm.common import table
from tests.conftest import SF
from tests.llm.conftest import EDGES


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, done = min(known) if known else None, False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), not done, hashlib.sha256(norm.encode()).hexdigest()))
            done = True
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_keys", [exact_dedup.BUCKET_KEYS, 3])
def test_classes(spark, edges, bucket_keys):
    for docs in (table(spark, SF, "documents"), edges):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs, bucket_keys).collect()), key=str)
        assert got == brute(rows)


def test_directory_doubles_only_where_full():
    cells = np.array([0, 1, 2, 3, 1 << 15])
    first, local, deepest = exact_dedup.directory(cells, np.array([5, 5, 5, 5, 5]), 10, depth=16)
    counts = dict(zip(cells.tolist(), [5] * 5))
    ends = [*first[1:].tolist(), 1 << 16]
    assert first[0] == 0 and all(b - a == 1 << 16 - d for a, b, d in zip(first.tolist(), ends, local.tolist()))
    assert max(sum(v for c, v in counts.items() if a <= c < b) for a, b in zip(first.tolist(), ends)) <= 10
    assert deepest == 15 and local.min() == 1
    one, depth, g = exact_dedup.directory(np.array([7]), np.array([100]), 10, depth=4)  # cannot be split: overfull
    assert g == 4 and depth.max() == 4


def test_chains_are_written(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)] + [(99, "alone")], "doc_id long, text string")
    entries, directory, chains = exact_dedup.build_index(docs, 2)
    assert entries.count() == 51 and chains.count() == 7 and directory.count() > 1
    assert {r.chain for r in chains.collect()} == {0}
    buckets = {r.bucket: r.first_cell for r in directory.collect()}
    for r in chains.collect():
        cell = (r.key % (1 << 64)) >> 64 - exact_dedup.DEPTH
        assert r.bucket == max(b for b, c in buckets.items() if c <= cell)


def test_stage(edges, empty):
    kept = exact_dedup.drop_duplicates(edges)
    assert kept.columns == edges.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in EDGES})
    assert {i for i, _ in rows} == {1, 3, 5, 6, 8, 9, 10, None}
    assert exact_dedup.drop_duplicates(empty).count() == 0 and exact_dedup.exact_duplicates(empty).count() == 0
