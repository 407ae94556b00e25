"""Queries for training, scoring and forecasting.

Tree libraries and solvers are not bit-equal across engines, so fits are checked by what must hold for
any of them; splits, the future frame, metrics and post-processing are compared value by value.
The feature table is stored and the models are fitted once per session.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from airsignal.ml import forecast as FC
from airsignal.ml import models as M
from airsignal.operators import features as FE
from airsignal.plans.frames import OBS_WIDE_SQL, obs_wide
from airsignal.plans.q_columns import CAT_SQL
from airsignal.plans.q_features import _all_features_sql
from airsignal.plans.registry import oracle, register
from airsignal.session import scratch_path

K = ["location_id"]
KEY = ["location_id", "ts"]

# Feature columns of ``all_features`` over the hourly readings (fixed by the feature vocabulary).
_AF_COLS = (["pm25", "pm10", "temperature", "humidity", "wind_speed"] + FE.TIME_COLS
            + ["temperature_squared", "temperature_cubed", "humidity_squared", "wind_speed_squared",
               "pm25_squared", "pm25_log", "pm10_squared", "pm10_log",
               "pollutant_sum", "pollutant_mean", "pollutant_std", "pollutant_max"]
            + [f"{c}_lag_{k}" for c in ["temperature", "humidity", "wind_speed", "pm25", "pm10"] for k in (1, 2, 3)]
            + [f"{c}_change_rate" for c in ["temperature", "humidity", "wind_speed", "pm25", "pm10"]]
            + [f"{c}_change_rate_pct" for c in ["temperature", "humidity", "wind_speed", "pm25", "pm10"]]
            + [f"{c}_rolling_{s}_24h" for c in ["temperature", "humidity", "wind_speed", "pm25", "pm10"]
               for s in ("mean", "std", "min", "max")]
            + [f"{c}_rolling_{s}_7d" for c in ["temperature", "humidity", "wind_speed", "pm25", "pm10"]
               for s in ("mean", "std")]
            + ["temp_humidity_interaction", "pm25_pm10_ratio", "wind_pm25_interaction"])


_STORED: dict[tuple, object] = {}


def _once(spark, sf, what, make):
    """Made once per session and state of the table: features are stored and models fitted once, then used by many queries."""
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/events.parquet")
    fs = table.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(table))
    key = (spark.sparkContext.applicationId, sf, tuple(files), what)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def computed_features(spark, sf):
    return FE.all_features(obs_wide(spark, sf), K, "ts", "aqi")


def features_table(spark, sf):
    """The feature table, stored (wide, typed, NULLs kept) on first use as the feature job would, and read from there."""
    def store():
        path = scratch_path(spark, "feature-table")
        d = computed_features(spark, sf)
        d.write.parquet(path)
        return path, d.schema

    path, schema = _once(spark, sf, "features", store)
    return spark.read.schema(schema).parquet(path)


def prepared(spark, sf):
    """(train, validation, test, feature columns, fitted prep) from the full feature table, split once."""
    def make():
        data, cols, prep = M.xy(features_table(spark, sf), "aqi", keys=KEY)
        return M.reliable(M.split_random(data.select(*KEY, "features", "label"), (0.7, 0.1, 0.2), 42, KEY)), cols, prep

    data, cols, prep = _once(spark, sf, "prepared", make)
    split = lambda n: data.filter(F.col("split") == n)
    return split("train"), split("validation"), split("test"), cols, prep


def best_run(spark, sf):
    """(results of all four estimators on validation and test, fitted models, feature columns)."""
    def make():
        train, val, test, cols, _ = prepared(spark, sf)
        return (*M.compare_models(train, val, test=test, stored=True), cols)

    return _once(spark, sf, "models", make)


def best_model(spark, sf):
    res, fitted, _ = best_run(spark, sf)
    return fitted[res.orderBy(F.col("rmse").asc_nulls_last(), "position").first()["model"]]


def finite(*cols):
    """All the columns are numbers: neither NULL, NaN nor infinite."""
    e = F.lit(True)
    for c in cols:
        e = e & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return e


def _xy_sql():
    """Mean imputation over the whole feature table, for every feature and the label."""
    from airsignal.plans.registry import OracleSQL

    af = _all_features_sql()
    inner = af[len("WITH "):].replace("__q AS (", "hist AS (", 1).rsplit("SELECT * REPLACE", 1)[0].rstrip().rstrip(",")
    cols = ", ".join(f"CAST(coalesce({c}, avg({c}) OVER ()) AS DOUBLE) AS {c}" for c in _AF_COLS)
    body = f"WITH {inner}\nSELECT location_id, ts, CAST(coalesce(aqi, avg(aqi) OVER ()) AS DOUBLE) AS label, {cols} FROM hist"
    spec = {c: (4 if c.endswith(("_squared", "_cubed", "_interaction")) else 6) for c in ["label", *_AF_COLS]}
    rep = ", ".join(f'round(TRY_CAST("{c}" AS DECIMAL(38, 9)), {d})::DOUBLE + 0.0 AS "{c}"' for c, d in spec.items())
    out = OracleSQL(f"SELECT * REPLACE ({rep}) FROM (\n{body}\n)")
    out.digits = spec
    return out


@register("xy", _xy_sql())
def q_xy(spark, sf):
    """(X, y) preparation; the assembled vector is returned as named columns so values can be checked."""
    data, cols, _ = M.xy(features_table(spark, sf), "aqi", keys=KEY)
    arr = vector_to_array("features")
    return data.select(*KEY, "label", *[arr[i].alias(c) for i, c in enumerate(cols)])


# part sizes of the two holdout splits: ceil((0.2 + 0.1) n) held out, ceil(0.2 / (0.2 + 0.1)) of these for the test
_SIZES_SQL = """sizes AS (SELECT n, held, CAST(ceil((0.2::DOUBLE / (0.2::DOUBLE + 0.1::DOUBLE)) * held) AS BIGINT) AS test
  FROM (SELECT n, CAST(ceil((0.2::DOUBLE + 0.1::DOUBLE) * n) AS BIGINT) AS held FROM (SELECT count(*) AS n FROM obs_wide)))"""


@register("split_random", oracle([OBS_WIDE_SQL, _SIZES_SQL], """
SELECT 'train' AS split, n - held AS n_rows, n - held AS n_keys FROM sizes
UNION ALL SELECT 'validation', held - test, held - test FROM sizes UNION ALL SELECT 'test', test, test FROM sizes""", []))
def q_split_random(spark, sf):
    """Exact part sizes over the whole table, each row in one part."""
    d = M.split_random(obs_wide(spark, sf).select(*KEY, "aqi"), (0.7, 0.1, 0.2), 42, KEY)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*KEY).alias("n_keys"))


@register("split_time", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, aqi, CASE WHEN pr < 0.7 THEN 'train' WHEN pr < 0.8 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, percent_rank() OVER (PARTITION BY location_id ORDER BY ts) AS pr FROM obs_wide)""", ["aqi"]))
def q_split_time(spark, sf):
    return M.split_time(obs_wide(spark, sf).select(*KEY, "aqi"), (0.7, 0.1, 0.2), K, "ts")


@register("split_time_blocked", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, aqi, CASE WHEN pr < 0.7 THEN 'train' WHEN pr < 0.8 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, percent_rank() OVER (PARTITION BY location_id ORDER BY ts) AS pr FROM
  (SELECT CASE WHEN location_id % 7 = 0 THEN NULL ELSE location_id END AS location_id, ts, aqi FROM obs_wide))""", ["aqi"]))
def q_split_time_blocked(spark, sf):
    d = obs_wide(spark, sf).select(F.when(F.col("location_id") % 7 != 0, F.col("location_id")).alias("location_id"), "ts", "aqi")
    return M.split_time(d, (0.7, 0.1, 0.2), K, "ts", strategy="blocked")


# A model's numbers have no SQL form; what must hold for any of them does: every validation row has one finite
# prediction, and the model is no worse than predicting the mean (r2 > 0).
def _fit_sql(name, learns="true"):
    return oracle([OBS_WIDE_SQL, _SIZES_SQL], f"""
SELECT '{name}' AS model, held - test AS n_scored, held - test AS n_finite, {learns} AS learns FROM sizes""", [])


def _fit_check(spark, sf, name, model):
    val = prepared(spark, sf)[1]
    scored = model.transform(val)
    r2 = M.metrics(scored)["r2"]
    return scored.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_scored"),
                      F.count(F.when(finite("prediction"), 1)).alias("n_finite"), F.lit(r2 > 0).alias("learns"))


def _train(spark, sf):
    return prepared(spark, sf)[0].select("features", "label")


@register("fit_random_forest", _fit_sql("random_forest"))
def q_fit_random_forest(spark, sf):
    return _fit_check(spark, sf, "random_forest", M.fit_random_forest(_train(spark, sf)))


@register("fit_gbt", _fit_sql("gbt"))
def q_fit_gbt(spark, sf):
    return _fit_check(spark, sf, "gbt", M.fit_gbt(_train(spark, sf)))


@register("fit_ridge", _fit_sql("ridge"))
def q_fit_ridge(spark, sf):
    return _fit_check(spark, sf, "ridge", M.fit_ridge(_train(spark, sf), 1.0))


@register("fit_lasso", _fit_sql("lasso"))
def q_fit_lasso(spark, sf):
    return _fit_check(spark, sf, "lasso", M.fit_lasso(_train(spark, sf), 0.1))


@register("fit_kernel_approx", _fit_sql("kernel"))
def q_fit_kernel_approx(spark, sf):
    return _fit_check(spark, sf, "kernel", M.fit_kernel_approx(_train(spark, sf)))


_MODELS_SQL = "(VALUES " + ", ".join(f"({k}, '{m}')" for k, m in enumerate(M.ESTIMATORS)) + ") AS m(position, model)"


@register("compare_models", oracle([], f"""
SELECT position, model, true AS scored, true AS tested, CAST(NULL AS VARCHAR) AS error FROM {_MODELS_SQL}""", []))
def q_compare_models(spark, sf):
    res, _, _ = best_run(spark, sf)
    return res.select("position", "model", finite("rmse", "mae", "r2").alias("scored"),
                      finite("test_rmse", "test_mae", "test_r2").alias("tested"), "error")


@register("registry_save", oracle([OBS_WIDE_SQL, _SIZES_SQL], """
SELECT true AS best_of_run, test AS n_scored, test AS n_finite FROM sizes""", []))
def q_registry_save(spark, sf):
    """All models of a run saved after an older run with better scores on paper; the latest run's best is loaded and scores the test part."""
    res, fitted, cols = best_run(spark, sf)
    path = scratch_path(spark, "registry")
    M.registry_save(fitted["ridge"], "ridge", {"rmse": 0.0}, cols, path, "2024-01-01T00:00:00")
    best = M.save_run(spark, res, fitted, cols, path, "2024-02-01T00:00:00")
    name, model = M.registry_load(spark, path)
    return model.transform(prepared(spark, sf)[2]).agg(
        F.lit(name == best).alias("best_of_run"), F.count(F.lit(1)).alias("n_scored"), F.count(F.when(finite("prediction"), 1)).alias("n_finite"))


@register("feature_importance", oracle([], "SELECT unnest([" + ", ".join(f"'{c}'" for c in _AF_COLS)
                                       + "]) AS feature, true AS in_range, true AS sums_to_one", []))
def q_feature_importance(spark, sf):
    """Importances of the forest (100 trees, depth 10) for every feature: each in [0, 1], 1 together."""
    _, fitted, cols = best_run(spark, sf)
    imp = M.feature_importance(spark, fitted["random_forest"], cols)
    total = imp.agg(F.sum("importance")).first()[0]
    return imp.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


def _recent_sql(body):
    """Over the feature table (``hist``) with NULLs replaced by the means, its rows of the last 24 hours."""
    af = _all_features_sql()
    inner = af[len("WITH "):].replace("__q AS (", "hist AS (", 1).rsplit("SELECT * REPLACE", 1)[0].rstrip().rstrip(",")
    return f"""WITH {inner}, filled AS (SELECT location_id, ts, coalesce(aqi, avg(aqi) OVER ()) AS y,
  coalesce(pm25_rolling_mean_24h, avg(pm25_rolling_mean_24h) OVER ()) * 2.0::DOUBLE AS p FROM hist),
recent AS (SELECT * FROM filled WHERE ts >= (SELECT max(ts) FROM hist) - INTERVAL 24 HOUR)
{body}"""


def _oracle_text(text, cols):
    from airsignal.plans.registry import OracleSQL

    rep = ", ".join(f'round(TRY_CAST("{c}" AS DECIMAL(38, 9)), 6)::DOUBLE + 0.0 AS "{c}"' for c in cols)
    out = OracleSQL(f"SELECT * REPLACE ({rep}) FROM (\n{text}\n)" if cols else text)
    out.digits = {c: 6 for c in cols}
    return out


#: A model whose prediction SQL can compute too.
_COLUMN_MODEL = "SELECT *, pm25_rolling_mean_24h * 2.0D AS prediction FROM __THIS__"


@register("evaluate_recent", _oracle_text(_recent_sql("""
SELECT location_id, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  avg(abs((y - p) / CASE WHEN y <> 0 THEN y END)) * 100.0::DOUBLE AS mape,
  1.0::DOUBLE - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2 FROM recent GROUP BY location_id"""),
    ["rmse", "mae", "mape", "r2"]))
def q_evaluate_recent(spark, sf):
    from pyspark.ml.feature import SQLTransformer

    class FromColumn:
        """Predicts from the imputed columns of the prepared rows."""

        def __init__(self, cols):
            self.at = cols.index("pm25_rolling_mean_24h")

        def transform(self, df):
            return SQLTransformer(statement=_COLUMN_MODEL).transform(
                df.withColumn("pm25_rolling_mean_24h", vector_to_array("features")[self.at]))

    _, _, _, cols, prep = prepared(spark, sf)
    return M.evaluate_recent(features_table(spark, sf), prep, FromColumn(cols), 24, None, "ts", K)


@register("evaluate_recent_best", _oracle_text(_recent_sql(
    "SELECT location_id, count(*) AS n, true AS scored FROM recent GROUP BY location_id"), []))
def q_evaluate_recent_best(spark, sf):
    prep = prepared(spark, sf)[4]
    res = M.evaluate_recent(features_table(spark, sf), prep, best_model(spark, sf), 24, None, "ts", K)
    return res.select("location_id", "n", finite("rmse", "mae").alias("scored"))


@register("cross_validate", oracle([OBS_WIDE_SQL, _SIZES_SQL], """
SELECT 2 AS n_params, 3 AS n_folds, true AS scores_finite, held - test AS n_finite FROM sizes""", []))
def q_cross_validate(spark, sf):
    """Two parameters over three rolling-origin folds of the training part."""
    from pyspark.ml.regression import LinearRegression

    cv = M.cross_validate(prepared(spark, sf)[0].select("ts", "features", "label"), LinearRegression(), {"regParam": [0.01, 1.0]}, 3, ts="ts")
    ok = len(cv.avgMetrics) == 2 and all(0 <= v < float("inf") for s in cv.foldMetrics for v in s)
    return cv.transform(prepared(spark, sf)[1]).agg(
        F.lit(len(cv.avgMetrics)).alias("n_params"), F.lit(len(cv.foldMetrics[0])).alias("n_folds"), F.lit(ok).alias("scores_finite"),
        F.count(F.when(finite("prediction"), 1)).alias("n_finite"))


@register("cross_validate_folds", oracle([OBS_WIDE_SQL, """t AS (SELECT location_id, ts, epoch_us(ts) AS u FROM obs_wide)""", """b AS (SELECT min(u) AS low, max(u) - min(u) + 1 AS span FROM t)""",
    """c AS (SELECT k AS fold, low + CAST(floor(span * (0.4::DOUBLE + (1 - 0.4::DOUBLE) * k / 3)) AS BIGINT) AS a,
  low + CAST(floor(span * (0.4::DOUBLE + (1 - 0.4::DOUBLE) * (k + 1) / 3)) AS BIGINT) AS z FROM b, range(0, 3) AS g(k))""", """f AS (
  SELECT location_id, ts, u, CAST(fold AS INTEGER) AS fold, CASE WHEN u < a - 168 * 3600000000 THEN 'train' ELSE 'validation' END AS part
  FROM t, c WHERE u < a - 168 * 3600000000 OR (u >= a AND u < z))""", """s AS (
  SELECT fold, max(u) FILTER (WHERE part = 'train') AS trained, min(u) FILTER (WHERE part = 'validation') AS begins FROM f GROUP BY fold)"""],
    "SELECT location_id, ts, f.fold, part, s.begins - s.trained > 168 * 3600000000 AS apart FROM f JOIN s ON f.fold = s.fold", []))
def q_cross_validate_folds(spark, sf):
    """Folds of every row; no training row stands within the gap of its fold's validation rows."""
    rows = M.rolling_folds(obs_wide(spark, sf).select(*KEY), 3, 168.0, 0.4, "ts")
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = rows.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", u)).alias("trained"), F.min(F.when(F.col("part") == "validation", u)).alias("begins"))
    return rows.join(F.broadcast(ends), "fold").select(*KEY, "fold", "part", (F.col("begins") - F.col("trained") > 168 * 3_600_000_000).alias("apart"))


_SC = ["pm25", "temperature", "aqi"]


@register("scale_features", oracle([OBS_WIDE_SQL], "SELECT o.location_id, o.ts, " + ", ".join(
    f"(o.{c} - s.c_{c}) / CASE WHEN s.s_{c} <> 0 THEN s.s_{c} ELSE 1 END AS {c}" for c in _SC)
    + " FROM obs_wide o JOIN (SELECT location_id, " + ", ".join(
    f"avg({c}) AS c_{c}, stddev_samp({c}) AS s_{c}" for c in _SC)
    + " FROM obs_wide GROUP BY location_id) s ON o.location_id = s.location_id", _SC))
def q_scale_features(spark, sf):
    return M.scale_features(obs_wide(spark, sf).select(*KEY, *_SC), _SC, "standard", K)


@register("scale_features_robust", oracle([OBS_WIDE_SQL], "SELECT o.location_id, o.ts, " + ", ".join(
    f"(o.{c} - s.c_{c}) / CASE WHEN s.s_{c} <> 0 THEN s.s_{c} ELSE 1 END AS {c}" for c in _SC)
    + " FROM obs_wide o JOIN (SELECT location_id, " + ", ".join(
    f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in _SC)
    + " FROM obs_wide GROUP BY location_id) s ON o.location_id = s.location_id", _SC))
def q_scale_features_robust(spark, sf):
    return M.scale_features(obs_wide(spark, sf).select(*KEY, *_SC), _SC, "robust", K)


def _future_sql(as_of=None):
    af = _all_features_sql()
    inner = af[len("WITH "):]
    inner = inner.replace("__q AS (", "hist AS (", 1).rsplit("SELECT * REPLACE", 1)[0].rstrip().rstrip(",")
    # column list of the feature table, in the order Spark produces it
    cols = [c for c in _AF_COLS]
    body = FC.future_frame_sql(inner, cols, 72, as_of)
    dbl = [c for c in cols if c not in FC._INT_COLS]
    from airsignal.plans.registry import OracleSQL
    spec = {c: (4 if c.endswith(("_squared", "_cubed", "_interaction")) else 6) for c in dbl}
    rep = ", ".join(f'round(TRY_CAST("{c}" AS DECIMAL(38, 9)), {d})::DOUBLE + 0.0 AS "{c}"' for c, d in spec.items())
    out = OracleSQL(f"SELECT * REPLACE ({rep}) FROM (\n{body}\n)")
    out.digits = spec
    return out


@register("future_frame", _future_sql())
def q_future_frame(spark, sf):
    return FC.future_frame(features_table(spark, sf), _AF_COLS, 72, K, "ts")


@register("future_frame_as_of", _future_sql("2024-01-25 12:30:00"))
def q_future_frame_as_of(spark, sf):
    return FC.future_frame(features_table(spark, sf), _AF_COLS, 72, K, "ts", as_of="2024-01-25 12:30:00")


@register("forecast", _oracle_text(_recent_sql("""
SELECT location_id, CAST(i AS INTEGER) AS step, last_ts + (i + 1) * INTERVAL 1 HOUR AS ts,
  CASE WHEN x IS NOT NULL THEN greatest(0.0::DOUBLE, x) END AS aqi, """ + CAT_SQL.format(c="x") + """ AS category,
  0.85::DOUBLE - 0.02::DOUBLE * i AS confidence
FROM (SELECT *, m - 4.0::DOUBLE * i AS x FROM (SELECT location_id, max(ts) AS last_ts, avg(pm25_rolling_mean_24h) AS m
      FROM hist GROUP BY location_id) CROSS JOIN range(0, 72) AS g(i))"""), ["aqi", "confidence"]))
def q_forecast(spark, sf):
    """Post-processing over a prediction that SQL can compute: the mean of a feature less four per step."""
    from pyspark.ml.feature import SQLTransformer

    fut = FC.future_frame(features_table(spark, sf), _AF_COLS, 72, K, "ts")
    model = SQLTransformer(statement="SELECT *, pm25_rolling_mean_24h - 4.0D * step AS prediction FROM __THIS__")
    return FC.forecast(model, fut, K)


@register("forecast_best", oracle([OBS_WIDE_SQL], """
SELECT location_id, 72 AS n_steps, true AS scored, true AS floored FROM obs_wide GROUP BY location_id""", []))
def q_forecast_best(spark, sf):
    """The best of the four models over 72 hours of every location."""
    _, _, _, cols, prep = prepared(spark, sf)
    fut = FC.future_frame(features_table(spark, sf), cols, 72, K, "ts")
    out = FC.forecast(best_model(spark, sf), prep.transform(fut.withColumn("label", F.lit(0.0))), K)
    return out.groupBy("location_id").agg(F.count(F.lit(1)).cast("int").alias("n_steps"), F.bool_and(finite("aqi")).alias("scored"),
                                          F.bool_and(F.col("aqi") >= 0).alias("floored"))
