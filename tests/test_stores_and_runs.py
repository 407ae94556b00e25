"""Stores keep what they hold, runs pick their own best model, logs of both shapes are read."""

import json

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from airsignal.ml import models as M
from airsignal.operators import windows as W
from airsignal.operators.features import all_features, derived_features
from airsignal.operators.insights import format_display
from airsignal.session import checkpoint_root, scratch_path
from airsignal.sources import parse as P
from airsignal.sources import runlog as RL
from airsignal.sources import store as ST
from airsignal.streaming import streams as STR

K = ["location_id"]


def hours(spark, start, n, value=1.0):
    return spark.range(start, start + n).selectExpr(
        "1L as location_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", f"cast(id as double) * {value} as x",
        "50.0D as aqi")


def test_merge_keeps_stored_rows_of_a_day(spark):
    path = scratch_path(spark, "f")
    ST.feature_write(hours(spark, 0, 24), path, "aqi", K, "ts", mode="merge")
    ST.feature_write(hours(spark, 20, 26, 2.0), path, "aqi", K, "ts", mode="merge")
    rows = {r.ts.hour + 24 * (r.ts.day - 1): r.x for r in ST.feature_read(spark, path).collect()}
    assert rows == {h: float(h if h < 20 else 2 * h) for h in range(46)}


def test_merge_into_json_form_and_missing_columns(spark):
    path = scratch_path(spark, "f")
    ST.feature_write(hours(spark, 0, 5), path, "aqi", K, "ts", as_json=True, mode="merge")
    ST.feature_write(hours(spark, 3, 5), path, "aqi", K, "ts", as_json=True, mode="merge")
    assert ST.feature_read(spark, path, columns=["x"]).count() == 8
    wide = scratch_path(spark, "w")
    ST.feature_write(hours(spark, 0, 5), wide, "aqi", K, "ts")
    assert {r.y for r in ST.feature_read(spark, wide, columns=["x", "y"]).collect()} == {None}


def test_latest_run_decides(spark):
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(30)], ["features", "label"])
    ridge, lasso, path = M.fit_ridge(df), M.fit_lasso(df, 0.1), scratch_path(spark, "reg")
    cols = "position int, model string, rmse double, mae double, r2 double, mape double"
    first = spark.createDataFrame([(0, "ridge", 1.0, 1.0, 1.0, 1.0), (1, "lasso", 9.0, 9.0, 0.0, 9.0)], cols)
    second = spark.createDataFrame([(0, "ridge", 50.0, 1.0, 1.0, 1.0), (1, "lasso", 5.0, 9.0, 0.0, 9.0)], cols)
    both = {"ridge": ridge, "lasso": lasso}
    assert M.save_run(spark, first, both, ["x"], path, "2024-01-01T00:00:00") == "ridge"
    assert M.registry_load(spark, path)[0] == "ridge"
    assert M.save_run(spark, second, both, ["x"], path, "2024-01-02T00:00:00") == "lasso"
    assert M.registry_load(spark, path)[0] == "lasso"
    assert M.registry_load(spark, path, run_ts="2024-01-01T00:00:00")[0] == "ridge"
    assert M.registry_load(spark, path, "nothing") == (None, None)


def test_failed_models_are_told(spark):
    df = spark.createDataFrame([(Vectors.dense([float(i), float(i % 3)]), 2.0 * i) for i in range(30)], ["features", "label"])

    def broken(d):
        raise ValueError("no")

    res, fitted = M.compare_models(df, df, {"bad": broken, "ridge": M.fit_ridge}, test=df)
    rows = {r.model: r for r in res.collect()}
    assert rows["bad"].rmse == float("inf") and "no" in rows["bad"].error and set(fitted) == {"ridge"}
    assert rows["ridge"].error is None and rows["ridge"].test_rmse == pytest.approx(rows["ridge"].rmse)
    with pytest.raises(RuntimeError):
        M.compare_models(df, df, {"bad": broken})


def test_run_logs_of_both_shapes(spark, tmp_path):
    log = {"model_name": "a", "timestamp": "t", "scores": {"rmse": 2.0, "mae": 1.0}, "feature_columns": ["x", "y"]}
    (tmp_path / "pretty.json").write_text(json.dumps(log, indent=2))
    (tmp_path / "line.json").write_text(json.dumps(log | {"model_name": "b", "scores": {"rmse": 1.0}}))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(log | {"model_name": m, "scores": {"rmse": 3.0}}) for m in "cd"))
    rows = [(r.model_name, r.rmse, r.n_features) for r in RL.run_history(spark, str(tmp_path)).collect()]
    assert rows == [("b", 1.0, 2), ("a", 2.0, 2), ("c", 3.0, 2), ("d", 3.0, 2)]


def test_feeds_reject_what_they_cannot_use(spark):
    docs = spark.createDataFrame([(1, "not json"), (2, '{"list": []}'), (3, None), (4, '{"list": [{"dt": 1, "main": {"aqi": 2}, "components": {"pm10": 3}}]}')],
                                 "id int, json string")
    good, bad = P.parse_pollution(docs)
    assert [(r.id, r.aqi, r.pm10, r.pm25) for r in good.collect()] == [(4, 100.0, 3.0, 0.0)] and bad.count() == 3
    good, bad = P.parse_weather(docs)
    assert good.count() == 0 and bad.count() == 4
    second = spark.createDataFrame([(1, '{"data": {"aqi": 7, "iaqi": {}}}'), (2, '{"status": "error", "data": "why"}'), (3, "x")], "id int, json string")
    good, bad = P.parse_second_source(second)
    assert [(r.id, r.aqi) for r in good.collect()] == [(1, 7.0)]
    assert {r.id: r.reason for r in bad.collect()} == {2: "source error: why", 3: "unparsable document"}
    good, bad = P.explode_forecast(docs)
    assert [r.id for r in good.collect()] == [4] and sorted(r.id for r in bad.collect()) == [1, 3]


def test_one_decimal_as_c_does(spark):
    xs = [0.25, 0.35, 1234.55, 0.15, 2.5, 0.05, 1e16, 0.45, -0.25, 123.45, 0.0, -0.04, 99.95, 1 / 3, 1e15, 8.5e13]
    d = format_display(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), {"x": ("y", "1f")})
    got = [r.y for r in d.collect()]
    assert [g.replace("-0.0", "0.0") if g else g for g in got] == [("%.1f" % x).replace("-0.0", "0.0") for x in xs] + [None]


def test_mode_ties_and_text_fill(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, None)], "location_id int, t string")
    assert sorted(r.t for r in W.fill_mode(d, ["t"], K).collect()) == ["Unknown", "a", "a", "a", "b", "b"]
    f = hours(spark, 0, 4).withColumn("sky", F.when(F.hour("ts") > 0, "clear"))
    assert {r.sky for r in all_features(f, K, "ts").collect()} == {"clear"}


def test_sparse_stream_equals_batch(spark):
    """One reading a day: frames count rows, so the look-back must too."""
    d = spark.range(60).selectExpr("id % 2 as location_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as ts",
                                   "cast(id as double) as aqi", "case when id % 20 < 2 then cast(id as double) end as pm25")
    land, store, out, ckpt = (scratch_path(spark, n) for n in ("land", "store", "out", "ckpt"))
    schema = "location_id long, ts string, aqi double, pm25 double"
    from pyspark.sql.types import StructType

    for lo, hi in ((0, 30), (30, 55), (55, 60)):
        part = d.filter((F.datediff("ts", F.lit("2024-01-01")) >= lo) & (F.datediff("ts", F.lit("2024-01-01")) < hi))
        part.withColumn("ts", F.col("ts").cast("string")).coalesce(1).write.mode("append").json(land)
        rows = STR.read_landing(spark, land, StructType.fromDDL(schema)).withColumn("ts", F.to_timestamp_ntz("ts"))
        STR.stream_features(spark, rows, store, out, ckpt)
    a = STR.read_stream_features(spark, out)
    b = derived_features(d, K, "ts")
    cols = sorted(b.columns)
    key = lambda r: (r.location_id, r.ts)
    x, y = (sorted(f.select(*cols).collect(), key=key) for f in (a, b))
    assert len(x) == len(y) == 60
    for p, q in zip(x, y):
        for c in cols:
            assert p[c] == q[c] or abs(p[c] - q[c]) < 1e-9, (p.ts, c, p[c], q[c])


def test_scaling_a_constant_column(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0)], "location_id int, x double")
    for kind in ("standard", "robust", "robust_approx"):
        assert {r.x for r in M.scale_features(d, ["x"], kind, K).collect()} == {0.0}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_root(Session())
