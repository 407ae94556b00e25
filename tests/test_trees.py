"""Trees as arrays, attributions by enumeration, boosting by closed forms, the kernel regression at its optimum."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor

from airsignal.ml import boost, kernel
from airsignal.ml import explain as X
from airsignal.ml import models as M
from airsignal.ml.trees import arrays_of
from airsignal.operators.insights import evaluate


def frame(spark, x, y):
    return spark.createDataFrame([(str(i), Vectors.dense(a.tolist()), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label"])


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 5)).round(2)
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] * x[:, 2] + np.abs(x[:, 3]) + rng.normal(scale=0.1, size=900)
    return x, y, frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])


def by_enumeration(t, x):
    """Shapley values of one row over all sets of features; the value of a set averages the others out by cover."""
    d = len(x)

    def value(known):
        def walk(n):
            f = t.feature[n]
            if f < 0:
                return t.value[n]
            if f in known:
                return walk(t.left[n] if x[f] <= t.threshold[n] else t.right[n])
            return sum(t.cover[c] / t.cover[n] * walk(c) for c in (t.left[n], t.right[n]))
        return t.base + sum(walk(r) for r in t.roots)

    out = np.zeros(d)
    for j in range(d):
        rest = [k for k in range(d) if k != j]
        for size in range(d):
            w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            out[j] += w * sum(value({*s, j}) - value(set(s)) for s in combinations(rest, size))
    return out, value(set())


@pytest.mark.parametrize("fit", [lambda d: M.fit_random_forest(d, num_trees=4, max_depth=6), lambda d: GBTRegressor(maxIter=4, maxDepth=3).fit(d),
                                 lambda d: M.fit_gbt(d, max_iter=4, max_depth=4)])
def test_attributions_equal_enumeration(spark, bent, fit):
    x, _, train, test = bent
    model = fit(train)
    t = arrays_of(spark, model)
    want = np.array([r.prediction for r in model.transform(test).collect()])
    assert t.predict(x[600:]) == pytest.approx(want, abs=1e-9)
    got = t.shap(x[600:620])
    for row, phi in zip(x[600:620], got):
        exact, base = by_enumeration(t, row)
        assert phi == pytest.approx(exact, abs=1e-9) and t.expected() == pytest.approx(base, abs=1e-9)
    long = {}
    names = [f"f{j}" for j in range(5)]
    for r in X.explain_shap(model, test, names).collect():
        long.setdefault(r.row_id, {})[r.feature] = r.shap
    assert len(long) == 300 and [long["5"][n] for n in names] == pytest.approx(got[5].tolist(), abs=1e-12)
    assert X.base_value(model, test) == pytest.approx(t.expected())


def test_lime_equals_one_regression_per_row(spark, bent):
    """Batched normal equations give what a weighted ridge of each row alone gives, and the perturbations are Spark's own draws."""
    x, _, train, test = bent
    model, d, n = M.fit_random_forest(train, num_trees=5, max_depth=4), 5, 60
    few = test.limit(7)
    got = {}
    for r in X.explain_lime(model, few, [f"f{j}" for j in range(d)], n_samples=n).collect():
        got.setdefault(r.row_id, {})[r.feature] = (r.weight, r.intercept, r.score)
    from pyspark.sql import functions as F

    z = few.select("row_id", "features", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("s")).select("row_id", "features", "s", *[
        F.when(F.col("s") == 0, F.lit(0.0)).otherwise(X._hash_normal([F.col("row_id"), F.col("s"), F.lit(j)], X.SEED)).alias(f"z{j}") for j in range(d)])
    rows = z.orderBy("row_id", "s").collect()
    sd = np.array([r.features.toArray() for r in few.collect()]).std(axis=0, ddof=1)
    t = arrays_of(spark, model)
    for i in {r.row_id for r in rows}:
        own = [r for r in rows if r.row_id == i]
        zs = np.array([[r[f"z{j}"] for j in range(d)] for r in own])
        y = t.predict(own[0].features.toArray() + zs * sd)
        w = np.exp(-(zs ** 2).sum(axis=1) / (0.75 ** 2 * d))
        zc, yc = zs - np.average(zs, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(d), (zc * w[:, None]).T @ yc)
        assert [got[i][f"f{j}"][0] for j in range(d)] == pytest.approx(coef.tolist(), abs=1e-9)


def test_leaves_by_closed_form(spark):
    """One tree of one split: -G / (H + l2) x step of each side, around the mean."""
    y = np.array([1.0, 2.0, 3.0, 10.0, 12.0, 14.0])
    model = boost.fit(frame(spark, np.arange(6.0)[:, None], y), rounds=1, max_depth=1, step=0.5, subsample=1, columns=1, l2=2.0)
    t, mean = model.trees, y.mean()
    assert (t.feature[0], t.threshold[0]) == (0, 2.0) and t.cover[:3].tolist() == [6, 3, 3]
    assert t.value[1] == pytest.approx(0.5 * (y[:3] - mean).sum() / (3 + 2)) and t.value[2] == pytest.approx(0.5 * (y[3:] - mean).sum() / (3 + 2))
    got = [r.prediction for r in model.transform(frame(spark, np.array([[0.0], [2.0], [2.5], [9.0]]), np.zeros(4))).collect()]
    assert got == pytest.approx([mean + t.value[1]] * 2 + [mean + t.value[2]] * 2)
    again = boost.fit(frame(spark, np.arange(6.0)[:, None], np.full(6, 4.0)), rounds=3)
    assert again.trees.predict(np.zeros((1, 1))) == pytest.approx([4.0])


def test_boosting_is_no_worse_than_first_order(bent):
    _, _, train, test = bent
    r2 = lambda m: evaluate(m.transform(test), "label", "prediction").first()["r2"]
    ours = r2(M.fit_gbt(train, max_iter=40))
    assert ours > 0.8 and ours >= r2(GBTRegressor(maxIter=40, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=1).fit(train)) - 0.01


def test_kernel_regression(bent):
    """Held out it learns; no smaller value of its objective is near."""
    x, y, train, test = bent
    model = M.fit_kernel_approx(train, n_components=150)
    assert evaluate(model.transform(test), "label", "prediction").first()["r2"] > 0.6
    phi, t = model.phi(x[:600]), (y[:600] - model.label_mean) / model.label_scale

    def objective(w, b):
        return 0.5 * w @ w + np.maximum(np.abs(t - phi @ w - b) - 0.1, 0).sum()

    best, rng = objective(model.w, model.b), np.random.default_rng(0)
    assert best < objective(model.w * 0, 0.0)
    for scale in (0.003, 0.03, 0.3):
        for _ in range(60):
            assert objective(model.w + scale * rng.normal(size=len(model.w)), model.b + scale * rng.normal()) > best * (1 - 2e-3)
    loss, slope, _ = kernel.smooth_loss(np.array([-2.0, -0.05, 0.0, 0.15, 1.0]), 0.1, 0.1)
    assert loss == pytest.approx([1.85, 0, 0, 0.0125, 0.85]) and slope == pytest.approx([-1, 0, 0, 0.5, 1])


def test_registry_keeps_both(spark, bent):
    from airsignal.session import scratch_path

    _, _, train, test = bent
    path = scratch_path(spark, "reg")
    for name, m in (("boost", M.fit_gbt(train, max_iter=3)), ("kernel", M.fit_kernel_approx(train, n_components=20))):
        M.registry_save(m, name, {"rmse": 1.0}, [], path, "2024-01-01T00:00:00")
        _, back = M.registry_load(spark, path, name)
        a, b = ([r.prediction for r in v.transform(test).collect()] for v in (m, back))
        assert a == pytest.approx(b, abs=1e-12)
