"""Whitening against numpy's eigenvalues, exact sums in integers, and awkward tables."""

import math

import numpy as np
import pytest

from airsignal.llm import queries as Q
from airsignal.llm import whitening as W
from airsignal.llm.common import table
from tests.conftest import SF


def brute(vectors):
    """(rows by place, n, sums, eigenvalues, eigenvectors, trace) with numpy."""
    good = {k: np.floor(256 * np.array(v, float)).astype(np.int64) for k, v in enumerate(vectors)
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array(sorted({tuple(v) for v in good.values()}))
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return good, len(x), x.sum(axis=0), e[::-1], u[:, ::-1], np.trace(c.T @ c / len(x))


def held(got, ids, vectors, components=4):
    good, n, sums, e, u, trace = brute(vectors)
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    assert sorted(rows) == sorted(ids[k] for k in good)
    sign = {}
    for k, x in good.items():
        for r in rows[ids[k]]:
            j = r.component - 1
            want = (x - sums / n) @ u[:, j] / math.sqrt(e[j])
            sign.setdefault(j, np.sign(want * r.whitened))
            assert r.whitened * sign[j] == pytest.approx(want, abs=1e-8)
            assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x, sums)) == int(r.deviation_wide)
            assert r.explained == pytest.approx(e[j] / trace, rel=1e-9) and r.identity_error < 1e-9
        assert sorted(r.component for r in rows[ids[k]]) == list(range(1, components + 1))


def test_query_against_numpy(spark):
    rows = table(spark, SF, "embeddings").collect()
    got = Q.op11_whitening(spark, SF).collect()
    held(got, [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 1], [1e6, 1e6 * (1 - 1e-7), 3, 2, 1, 0.5, 1e-3], [5, 5, 5, 5, 5, 4], [3, 2], [4, 1e-30, 0, 0, 0]])
def test_solver(values):
    """Close, equal, few and vanishing eigenvalues, to double precision."""
    rng = np.random.default_rng(len(values))
    d = max(len(values), 40 if len(values) > 5 else len(values))
    e = np.append(np.array(values, float), np.linspace(0.4, 0.01, d - len(values)) * min(values))
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got, u = W.jacobi_davidson(lambda w: v @ w, d, 4, float(np.trace(v)))
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
    want = want[want > np.finfo(float).eps * d * np.trace(v)]
    assert np.abs(got - want).max() <= 4 * np.finfo(float).eps * d * want[0]  # what eigvalsh itself may be off by
    assert np.linalg.norm(v @ u - u * got, axis=0).max() <= 2 * np.finfo(float).eps * max(d, 16) * want[0]
    assert np.allclose(u.T @ u, np.eye(len(got)), atol=1e-13)


def test_minres_is_the_least_residual():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    rhs, none = rng.normal(size=(12, 1)), [np.zeros((12, 0))]
    exact = W.minres(lambda w: a @ w, np.zeros(1), none, rhs, 12, 0.0)
    assert np.allclose(a @ exact, rhs, atol=1e-8)
    krylov = np.hstack([np.linalg.matrix_power(a, k) @ rhs for k in range(4)])
    best = krylov @ np.linalg.lstsq(a @ krylov, rhs, rcond=None)[0]
    got = W.minres(lambda w: a @ w, np.zeros(1), none, rhs, 4, 0.0)
    assert np.linalg.norm(a @ got - rhs) == pytest.approx(np.linalg.norm(a @ best - rhs), rel=1e-8)


SCHEMA = "vec_id long, embedding array<float>, label int, x int, n int, component int, part string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, "p", "b") for i, v in rows], SCHEMA).repartition(3)


def test_edges(spark):
    rng = np.random.default_rng(0)
    # float32 exactly, so that the brute force sees what Spark does
    vectors = [[float(np.float32(v)) for v in rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2]] for _ in range(60)]
    vectors += [vectors[0]] * 30 + [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]]
    rows = list(enumerate(vectors))
    ragged = [(900, [1.0, 2.0]), (901, [0.5] * 7)]
    for some in (rows, rows + ragged):
        d = frame(spark, some)
        got = W.whiten(d, W.fit(d)).collect()
        held(got, list(range(len(vectors))), vectors)
    twice = frame(spark, rows[:60] + rows[:60])
    assert W.whiten(twice, W.fit(twice)).count() == 480


def test_few_dimensions_and_none(spark):
    line = frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)] + [(None, [1.0, 2.0, 0.0])])
    got = W.whiten(line, W.fit(line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and all(r.explained == pytest.approx(1) for r in got)
    for none in (frame(spark, []), frame(spark, [(1, None)]), frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])):
        out = W.whiten(none, W.fit(none))
        assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_large_values_are_exact(spark):
    big = frame(spark, [(k, [1e30 if k == 0 else 2.0 ** 40 * k, float(k)]) for k in range(20)])
    rows = W.whiten(big, W.fit(big)).collect()
    x = [[2 ** 63 - 1 if k == 0 else 2 ** 48 * k, 256 * k] for k in range(20)]
    sums = [sum(c) for c in zip(*x)]
    for r in rows:
        want = sum((20 * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))
        assert r.deviation == (want if want < 2 ** 63 else None) and (r.deviation_wide is None or int(r.deviation_wide) == want)


def test_partial_sums_are_added_on_executors(spark, monkeypatch):
    d = table(spark, SF, "embeddings")
    want = W.fit(d)
    monkeypatch.setattr(W, "PARTIALS", 1)
    assert W.fit(d.repartition(7)).values == pytest.approx(want.values, rel=1e-12)
