"""Training, scoring and model management with Spark ML.

Training data is a DataFrame of feature columns plus a label. Linear models are Spark ML's; boosted
trees with second-order leaves (``boost``) and the kernel regression with the epsilon-insensitive loss
(``kernel``) are distributed sums over packed rows, as Spark ML has neither. So is the forest (``forest``):
Spark ML's shuffles sums of all nodes from every partition.
"""

from __future__ import annotations

import json
import logging
import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsignal.ml import boost, forest, kernel
from airsignal.ml.trees import Trees
from airsignal.session import reliable, sweep

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
SEED = 42
log = logging.getLogger(__name__)


# --- 67: features / label -------------------------------------------------------------

def feature_columns(df: DataFrame, target: str = "aqi", keys: Sequence[str] = ("location_id", "ts")) -> list[str]:
    return [c for c, t in df.dtypes if c not in keys and c != target and t in NUMERIC]


def xy(df: DataFrame, target: str = "aqi", feature_cols: Sequence[str] | None = None,
       keys: Sequence[str] = ("location_id", "ts")) -> tuple[DataFrame, list[str], PipelineModel]:
    """Mean-impute features and label, assemble ``features``; returns (frame, columns, fitted prep)."""
    cols = list(feature_cols) if feature_cols is not None else feature_columns(df, target, keys)
    d = df.withColumn("label", F.col(target).cast("double"))
    imputed = [f"__imp_{i}" for i in range(len(cols))]
    prep = Pipeline(stages=[
        Imputer(inputCols=[*cols, "label"], outputCols=[*imputed, "__label"], strategy="mean"),
        VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep"),
    ]).fit(d)
    out = prep.transform(d).drop(*imputed, "label").withColumnRenamed("__label", "label")
    return out, cols, prep


def prepare(prep: PipelineModel, df: DataFrame, target: str = "aqi") -> DataFrame:
    """Apply a fitted ``xy`` preparation to new rows (features + label)."""
    d = df.withColumn("label", F.col(target).cast("double"))
    imputed = [c for c in prep.stages[0].getOutputCols() if c != "__label"]
    return prep.transform(d).drop(*imputed, "label").withColumnRenamed("__label", "label")


# --- 68, 69: splits --------------------------------------------------------------------

def hash_uniform(cols: Sequence[str | Column], seed: int = SEED) -> Column:
    """A uniform number in [0, 1) from a hash of the row keys: the same under any partitioning."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return (F.pmod(h, F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))


def split_sizes(n: int, fractions: Sequence[float] = (0.7, 0.1, 0.2)) -> list[int]:
    """Part sizes of (train, validation, test) as the reference's two holdout splits compute them.

    First ``held = ceil((test + validation) * n)`` rows are held out, then
    ``ceil(test / (test + validation) * held)`` of them are test — with the same
    floating-point expressions (e.g. 0.2 + 0.1 = 0.30000000000000004, so n = 2000
    holds out 601 rows).
    """
    if len(fractions) != 3:
        raise ValueError("fractions must be (train, validation, test)")
    _, val, test = (float(x) for x in fractions)
    held = min(n, math.ceil((test + val) * n))
    n_test = min(held, math.ceil(test / (test + val) * held)) if held else 0
    return [n - held, held - n_test, n_test]


def split_random(df: DataFrame, fractions: Sequence[float] = (0.7, 0.1, 0.2), seed: int = SEED,
                 keys: Sequence[str] = ("location_id", "ts"),
                 names: Sequence[str] = ("train", "validation", "test"), exact: bool = True) -> DataFrame:
    """Adds ``split``: a random split decided by a hash of the row keys (same under any partitioning).

    ``exact=True`` gives exact part sizes: rows are ranked by their hash. Two narrow scans find the hash of the last
    row of each part (counts per range of hashes, then one range's hashes), and the rows stay where they are. Where rows on both sides
    of an end share its hash, they are ranked with the distributed row number of :mod:`airsignal.operators.series`.
    ``exact=False`` cuts the hash uniform directly (no shuffle, sizes approximate).
    """
    u = hash_uniform(keys, seed)
    if not exact:
        cuts = np.cumsum(fractions) / float(sum(fractions))
        e = F.when(u < float(cuts[0]), names[0])
        for cut, name in zip(cuts[1:-1], names[1:-1]):
            e = e.when(u < float(cut), name)
        return df.withColumn("split", e.otherwise(names[-1]))
    h = F.pmod(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)), F.lit(1 << 53))
    counts = {r.part: r.n for r in df.select(_hash_range(h).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    bounds = [int(b) for b in np.cumsum(split_sizes(n, fractions))]
    ends = [_last_hash(df, h, counts, b) for b in bounds[:-1]]
    if None not in ends:
        e = F.when(h <= F.lit(ends[0]), names[0])
        for end, name in zip(ends[1:], names[1:-1]):
            e = e.when(h <= F.lit(end), name)
        return df.withColumn("split", e.otherwise(names[-1]))
    from airsignal.operators.series import RN, series_row_number

    ranked = series_row_number(df.withColumn("__h", h), [], ["__h", *keys],
                               chunk_width=max(1, (1 << 53) // max(1, n // 1000)))
    e = F.when(F.col(RN) <= bounds[0], names[0])
    for b, name in zip(bounds[1:-1], names[1:-1]):
        e = e.when(F.col(RN) <= b, name)
    return ranked.withColumn("split", e.otherwise(names[-1])).drop("__h", RN)


#: Ranges of hashes that are counted, by their upper bits, and rows of a range that are sorted at most.
RANGE_BITS, RANGE_ROWS = 16, 1 << 20


def _hash_range(h: Column) -> Column:
    return F.shiftright(h, 53 - RANGE_BITS).cast("int")


def _last_hash(df: DataFrame, h: Column, counts: Mapping[int, int], rank: int) -> int | None:
    """The hash of the row of this rank; None where the next row has the same, or too many rows share the range."""
    if rank <= 0:
        return -1
    below = 0
    for part in sorted(counts):
        if below + counts[part] >= rank:
            break
        below += counts[part]
    if counts[part] > RANGE_ROWS:
        return None
    near = [r.h for r in df.select(h.alias("h")).filter(_hash_range(F.col("h")) == part).orderBy("h").offset(rank - below - 1).limit(2).collect()]
    return None if len(near) == 2 and near[0] == near[1] else near[0]


def split_time(df: DataFrame, fractions: Sequence[float] = (0.7, 0.1, 0.2), keys: Sequence[str] = ("location_id",),
               ts: str = "ts", names: Sequence[str] = ("train", "validation", "test"), strategy: str | None = None) -> DataFrame:
    """Adds ``split``: chronological per location by percent rank (no look-ahead through lags).

    The blocked strategy ranks with the distributed row number: equal times share the smallest, and
    (rank - 1) / (rows - 1) is compared with the cuts, so no task holds a whole location.
    """
    from pyspark.sql import Window

    from airsignal.operators.series import RN, choose_strategy, join_null_safe, series_row_number

    cuts = np.cumsum(fractions) / float(sum(fractions))
    if choose_strategy(df, strategy) == "blocked":
        first = F.min(RN).over(Window.partitionBy(*keys, ts))
        d = series_row_number(df, keys, [ts]).withColumn("__rank", first)
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        d = join_null_safe(d, counts, list(keys)) if keys else attach_row(d, counts)
        pr = F.coalesce(F.try_divide(F.col("__rank") - 1, (F.col("__n") - 1).cast("double")), F.lit(0.0))
    else:
        d, pr = df, F.percent_rank().over(Window.partitionBy(*keys).orderBy(ts))
    d = d.withColumn("__pr", pr)
    e = F.when(F.col("__pr") < float(cuts[0]), names[0])
    for cut, name in zip(cuts[1:-1], names[1:-1]):
        e = e.when(F.col("__pr") < float(cut), name)
    return d.withColumn("split", e.otherwise(names[-1])).drop("__pr", "__rank", "__n", RN)


# --- 70-73, 87: estimators ----------------------------------------------------------------

def fit_random_forest(train: DataFrame, num_trees: int = 100, max_depth: int = 10, min_leaf: int = 2,
                      seed: int = SEED) -> forest.Forest:
    """Reference: 100 trees, depth 10, leaf >= 2 (min split 5 is not kept), all features at every node; 32 bins."""
    return forest.fit(train, num_trees, max_depth, min_leaf, seed=seed)


def fit_gbt(train: DataFrame, max_iter: int = 100, max_depth: int = 6, step: float = 0.1,
            subsample: float = 0.8, columns: float = 0.8, l2: float = 1.0, seed: int = SEED) -> boost.NewtonTrees:
    """Reference: 100 boosted trees with second-order leaves, depth 6, rate 0.1, row and column sampling 0.8 per tree."""
    return boost.fit(train, max_iter, max_depth, step, subsample, columns, l2, seed=seed)


def _label_stats(train: DataFrame) -> tuple[float, int]:
    r = train.agg(F.stddev_pop("label"), F.count("label")).first()
    return float(r[0] or 0.0), int(r[1] or 0)


def fit_ridge(train: DataFrame, alpha: float = 1.0):
    """Closed-form ridge ||y - Xw - b||^2 + alpha ||w||^2 via Spark's normal-equation solver.

    Spark minimises 1/(2n) SSE + regParam/2 ||w||^2 on a label scaled by its
    standard deviation, hence regParam = alpha * sd(y) / n.
    """
    sd, n = _label_stats(train)
    reg = alpha * sd / max(n, 1) if sd > 0 else 0.0
    return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def fit_lasso(train: DataFrame, alpha: float = 1.0):
    """L1 linear model (imported but unused in the reference).

    Solved on the normal equations: one pass over the rows, and the iterations on their moments.
    """
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, solver="normal").fit(train)


def fit_kernel_approx(train: DataFrame, gamma: float | str = "scale", n_components: int = 256,
                      seed: int = SEED, c: float = 1.0, epsilon: float = 0.1) -> kernel.KernelModel:
    """SVR(kernel='rbf', C=1, gamma='scale') on ``n_components`` landmarks; features and label are standardised first."""
    return kernel.fit(train, n_components, gamma, c, epsilon, seed)


ESTIMATORS: dict[str, Callable[[DataFrame], object]] = {
    "random_forest": fit_random_forest,
    "xgboost": fit_gbt,
    "ridge": fit_ridge,
    "svr": fit_kernel_approx,
}


# --- 74-76: compare and pick -------------------------------------------------------------

def metrics(scored: DataFrame, label: str = "label", pred: str = "prediction") -> dict[str, float]:
    from airsignal.operators.insights import evaluate

    r = evaluate(scored, label, pred).first()
    return {k: (float(r[k]) if r[k] is not None else float("nan")) for k in ("rmse", "mae", "r2", "mape")}


def compare_models(train: DataFrame, val: DataFrame,
                   estimators: Mapping[str, Callable[[DataFrame], object]] | None = None,
                   test: DataFrame | None = None, stored: bool = False) -> tuple[DataFrame, dict[str, object]]:
    """Fit every estimator on ``train``, score on ``val`` (and on ``test``: ``test_`` columns).

    A failing model gets rmse/mae/mape = inf, r2 = 0 and its ``error``; when all fail, that raises.
    A loop over a handful of estimators on the driver; each fit is a distributed
    Spark ML job over the training frame, which is written once; not again where it is ``stored``.
    """
    estimators = estimators or ESTIMATORS
    spark = val.sparkSession
    train = train.select("features", "label")
    train = train if stored else reliable(train)
    sentinel = {"rmse": float("inf"), "mae": float("inf"), "r2": 0.0, "mape": float("inf")}
    names = list(sentinel)
    fitted, rows = {}, []
    for pos, (name, fit) in enumerate(estimators.items()):
        error, tested = None, dict.fromkeys(names)
        sweep(spark)  # files of what was made before, and of the fit before
        try:
            m = fit(train)
            s = metrics(m.transform(val))
            tested = tested if test is None else metrics(m.transform(test))
            fitted[name] = m
        except Exception as e:  # noqa: BLE001 - a failed model is recorded and the others go on
            log.warning("model %s failed: %s", name, e)
            s, error = sentinel, f"{type(e).__name__}: {e}"[:500]
        rows.append((pos, name, *[s[k] for k in names], *[tested[k] for k in names], error))
    if not fitted:
        raise RuntimeError("every model failed: " + "; ".join(f"{r[1]}: {r[-1]}" for r in rows))
    cols = [f"{p}{k} double" for p in ("", "test_") for k in names]
    return spark.createDataFrame(rows, ", ".join(["position int", "model string", *cols, "error string"])), fitted


# --- 77: registry ---------------------------------------------------------------------------

def registry_save(model, name: str, scores: Mapping[str, float], feature_cols: Sequence[str], path: str,
                  run_ts: str) -> None:
    """Model under ``path/models/<run>/<name>``; metadata row appended to ``path/metadata`` (JSON)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    folder = f"{path}/models/{_run_folder(run_ts)}/{name}"
    if isinstance(model, (kernel.KernelModel, boost.NewtonTrees)):
        params = model.params() if isinstance(model, kernel.KernelModel) else {
            "width": model.width, "gains": model.gains.tolist(),
            "trees": {f.name: v.tolist() if isinstance(v := getattr(model.trees, f.name), np.ndarray) else v for f in fields(model.trees)}}
        spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").json(folder)
    else:
        model.write().overwrite().save(folder)
    meta = spark.createDataFrame([(name, run_ts, type(model).__name__, json.dumps(dict(scores)), list(feature_cols))],
                                 METADATA)
    meta.write.mode("append").json(f"{path}/metadata")


METADATA = "model_name string, run_ts string, model_class string, scores string, feature_columns array<string>"


def _run_folder(run_ts: str) -> str:
    return re.sub(r"[^0-9A-Za-z_.-]", "-", run_ts)


def save_run(spark, results: DataFrame, fitted: Mapping[str, object], feature_cols: Sequence[str], path: str,
             run_ts: str) -> str:
    """Save every fitted model of a run and its results row (best model named). Returns the best model's name."""
    rows = results.collect()  # one row per estimator
    for r in rows:
        if r["model"] in fitted:
            registry_save(fitted[r["model"]], r["model"], {k: r[k] for k in ("rmse", "mae", "r2", "mape")}, feature_cols, path, run_ts)
    best = min((r for r in rows if r["model"] in fitted), key=lambda r: (r["rmse"], r["position"]))["model"]
    spark.createDataFrame([(run_ts, best)], "run_ts string, best_model string").write.mode("append").json(f"{path}/results")
    return best


_LOADERS = {
    "RandomForestRegressionModel": "pyspark.ml.regression.RandomForestRegressionModel",
    "GBTRegressionModel": "pyspark.ml.regression.GBTRegressionModel",
    "LinearRegressionModel": "pyspark.ml.regression.LinearRegressionModel",
}


def registry_load(spark, path: str, name: str | None = None, run_ts: str | None = None):
    """Load a model of a run, by default of the latest: by name, or that run's best (smallest rmse). Returns (name, model).

    An older run's score never decides: the best is chosen among the models of the one run.
    """
    meta = spark.read.schema(METADATA).json(f"{path}/metadata").withColumn(
        "rmse", F.get_json_object("scores", "$.rmse").cast("double"))
    if name is not None:
        meta = meta.filter(F.col("model_name") == name)
    if run_ts is None:
        run_ts = meta.agg(F.max("run_ts")).first()[0]
    row = meta.filter(F.col("run_ts") == run_ts).orderBy(F.col("rmse").asc_nulls_last(), "model_name").first()
    if row is None:
        return None, None
    cls, folder = row["model_class"], f"{path}/models/{_run_folder(run_ts)}/{row['model_name']}"
    if cls in ("KernelModel", "NewtonTrees", "Forest"):
        p = json.loads(spark.read.schema("params string").json(folder).first()["params"])
        if cls == "KernelModel":
            return row["model_name"], kernel.KernelModel(p["mean"], p["scale"], p["marks"], p["whiten"], p["w"], p["b"], p["gamma"], p["label_mean"], p["label_scale"])
        t = Trees(**{k: np.array(v) if isinstance(v, list) else v for k, v in p["trees"].items()})
        return row["model_name"], (forest.Forest if cls == "Forest" else boost.NewtonTrees)(t, p["width"], np.array(p["gains"]))
    mod, _, kls = _LOADERS[cls].rpartition(".")
    return row["model_name"], getattr(__import__(mod, fromlist=[kls]), kls).load(folder)


# --- 79: importances ------------------------------------------------------------------------

def feature_importance(spark, model, feature_cols: Sequence[str]) -> DataFrame:
    """Tree importances or |coefficients| per feature, sorted descending."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        vals = np.abs(model.coefficients.toArray())
    else:
        vals = np.zeros(len(feature_cols))
    rows = [(c, float(v)) for c, v in zip(feature_cols, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(),
                                                                                  "feature")


# --- 82: recent evaluation -------------------------------------------------------------------

def evaluate_recent(features: DataFrame, prep: PipelineModel, model, hours: float = 24, as_of=None,
                    ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Score the model on the last ``hours`` of the feature table (per key when ``keys``)."""
    from airsignal.operators.features import time_range_filter
    from airsignal.operators.insights import evaluate

    recent = time_range_filter(features, ts, hours, as_of)
    scored = model.transform(prepare(prep, recent))
    return evaluate(scored, "label", "prediction", keys)


from airsignal.operators.quantiles import exact_quantiles  # noqa: E402
from airsignal.operators.series import attach_row, join_null_safe  # noqa: E402


# --- 86, 88: cross validation and scaling -----------------------------------------------------

def rolling_folds(df: DataFrame, folds: int = 3, gap_hours: float = 168.0, first: float = 0.4, ts: str = "ts") -> DataFrame:
    """(row columns, fold, part): rolling-origin folds. Fold k validates on the k-th of ``folds`` equal spans after the first ``first`` of the time range, and trains on
    all rows at least ``gap_hours`` before that span, so no frame of a validation row reaches into the training rows (the longest
    has 168 rows, hours on a regular grid). Rows in a gap, and those after the span, are in no part of the fold.

    The only numbers that the driver sees are the first and last time. A row can be in several folds.
    """
    if folds < 1 or not 0 < first < 1 or gap_hours < 0:
        raise ValueError("folds >= 1, 0 < first < 1 and gap_hours >= 0 are needed")
    from airsignal.operators.series import order_number

    t = order_number(df, ts)
    low, high = df.agg(F.min(t), F.max(t)).first()
    if low is None:
        return df.limit(0).withColumns({"fold": F.lit(0), "part": F.lit("train")})
    span = high - low + 1
    cuts = [low + int(span * (first + (1 - first) * k / folds)) for k in range(folds + 1)]
    gap = int(round(gap_hours * 3_600_000_000))
    part = lambda k: F.when(t < F.lit(cuts[k] - gap), "train").when((t >= F.lit(cuts[k])) & (t < F.lit(cuts[k + 1])), "validation")
    each = F.array(*[F.struct(F.lit(k).alias("fold"), part(k).alias("part")) for k in range(folds)])
    return df.withColumn("__f", F.explode(F.filter(each, lambda x: x.getField("part").isNotNull()))).select(*df.columns, "__f.fold", "__f.part")


class CrossValidated:
    """Scores of every parameter set and fold, and the best set fitted on all rows."""

    def __init__(self, params: list[dict], scores: list[list[float]], bestModel) -> None:
        self.params, self.foldMetrics, self.bestModel = params, scores, bestModel
        self.avgMetrics = [float(np.mean(s)) if s else float("inf") for s in scores]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def cross_validate(train: DataFrame, estimator, grid: Mapping[str, Sequence] | None = None, folds: int = 5,
                   seed: int = SEED, ts: str | None = None, gap_hours: float = 168.0, first: float = 0.4):
    """Cross validation over a parameter grid (rmse).

    With ``ts`` by rolling origin (``rolling_folds``): validation respects time and the frames' reach; folds without training or validation rows are left out. Without
    it k random folds with Spark's CrossValidator, for rows that do not depend on one another (lags and frames of neighbours leak through random folds).
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    b = ParamGridBuilder()
    for pname, values in (grid or {}).items():
        b = b.addGrid(estimator.getParam(pname), list(values))
    params, judge = b.build(), RegressionEvaluator(metricName="rmse")
    if ts is None:
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=params, evaluator=judge, numFolds=folds, seed=seed, parallelism=2)
        return cv.fit(train)
    rows = reliable(rolling_folds(train, folds, gap_hours, first, ts))
    sizes = {(r.fold, r.part): r["count"] for r in rows.groupBy("fold", "part").count().collect()}
    scores: list[list[float]] = [[] for _ in params]
    for k in range(folds):
        if sizes.get((k, "train"), 0) and sizes.get((k, "validation"), 0):
            own, val = (rows.filter((F.col("fold") == k) & (F.col("part") == p)) for p in ("train", "validation"))
            for i, p in enumerate(params):
                scores[i].append(judge.evaluate(estimator.fit(own, p).transform(val)))
    if not any(scores):
        raise ValueError("no fold has both training and validation rows: fewer folds, a later start or a smaller gap")
    means = [float(np.mean(s)) for s in scores]
    return CrossValidated(params, scores, estimator.fit(train, params[int(np.argmin(means))]))


def scale_features(df: DataFrame, cols: Sequence[str], kind: str = "standard", keys: Sequence[str] = ()) -> DataFrame:
    """standard: (x - mean) / sample sd; robust: (x - median) / IQR (exact, interpolated quantiles).

    A column that does not vary (sd or IQR 0) is only centred; with one row the sd counts as 0. Statistics
    (one row per key group) are joined back. The exact quantiles come from narrowing histograms (:mod:`airsignal.operators.quantiles`),
    in bounded memory whatever the number of values; ``kind="robust_approx"`` reads the rows once instead (relative error 1e-4).
    """
    keys = list(keys)
    if kind == "standard":
        stats = df.groupBy(*keys).agg(*[x for c in cols for x in (F.avg(c).alias(f"__c_{c}"),
                                                                    F.stddev_samp(c).alias(f"__s_{c}"))])
    elif kind == "robust":
        stats = exact_quantiles(df, cols, (0.25, 0.5, 0.75), keys).select(*keys, *[x for k, c in enumerate(cols) for x in (
            F.col(f"q{k}_1").alias(f"__c_{c}"), (F.col(f"q{k}_2") - F.col(f"q{k}_0")).alias(f"__s_{c}"))])
    elif kind == "robust_approx":
        q = lambda c, p: F.percentile_approx(c, p, 10000)
        stats = df.groupBy(*keys).agg(*[x for c in cols for x in (
            q(c, 0.5).alias(f"__c_{c}"), (q(c, 0.75) - q(c, 0.25)).alias(f"__s_{c}"))])
    else:
        raise ValueError(f"unknown scaling {kind!r}")
    j = join_null_safe(df, stats, keys, "left") if keys else attach_row(df, stats)
    by = lambda c: F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) != 0, F.col(f"__s_{c}")).otherwise(F.lit(1.0))
    out = j.withColumns({c: (F.col(c) - F.col(f"__c_{c}")) / by(c) for c in cols})
    return out.drop(*[x for c in cols for x in (f"__c_{c}", f"__s_{c}")])
