"""Secret scans against regular expressions in Python, and the ledger's increments."""

import hashlib
import random
import re

import pytest

from airsignal.llm import secrets
from airsignal.session import scratch_path
from tests.llm.conftest import EDGES

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def brute(text):
    out = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    bits = ["password", "PassWd=", "secret :  ", "token=", "api_key: \"", "apikey'", "tok", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "ZZZZ", "0123456789abcdef", "deadbeef",
            "é", "日本", " ", "=", ": ", "'", "g", "\n", "-----BEGIN RSA PRIVATE KEY-----", "abcde", "abcdef"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(400)]


def test_base_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.digests(secrets.scan(docs, scratch_path(spark, "ledger"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == p for _, p, _, _ in want) for k in range(3)]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(",")) | {""}
    assert any("pem:" in r.spans for r in rows)


def test_edges(spark, edges, empty):
    rows = secrets.digests(secrets.scan(edges, scratch_path(spark, "ledger"))).collect()
    assert sorted((r.doc_id or 0, r.base_sha256) for r in rows) == sorted((i or 0, digest(brute(t))) for i, t, _ in EDGES)
    assert secrets.scan(empty, scratch_path(spark, "ledger")).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    path = scratch_path(spark, "ledger")
    rules = [secrets.Rule("hex", "[0-9a-f]{24,}", 0, 24), secrets.Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20)]
    key = "AKIA" + "A" * 16
    day1 = spark.createDataFrame([(1, key), (2, "a" * 24), (3, key)], "doc_id long, text string")
    day2 = spark.createDataFrame([(4, key), (5, "plain"), (6, "a" * 24)], "doc_id long, text string")
    pairs = lambda: sorted((r.blob[:6], r.kind, r.version) for r in spark.read.parquet(path).collect())
    first = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(day1, path, rules).collect()}
    assert first == {1: ["access"], 2: ["hex"], 3: ["access"]} and len(pairs()) == 4
    second = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(day2, path, rules).collect()}
    assert second == {4: ["access"], 5: [], 6: ["hex"]} and len(pairs()) == 6  # one new blob, two rules
    newer = [rules[0], secrets.Rule("access", "AKIA[A-Z0-9]{17,}", 0, 21, version=2)]
    third = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(day2, path, newer).collect()}
    assert third == {4: [], 5: [], 6: ["hex"]} and len(pairs()) == 9  # the changed rule on three blobs
    assert sum(v == 2 for _, _, v in pairs()) == 3
