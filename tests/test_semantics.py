"""Operator semantics on hand-made edge frames, against pandas (the reference's engine)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airsignal.functions import columns as C
from airsignal.operators import features as FE
from airsignal.operators import insights as I
from airsignal.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, loc=1, col="x"):
    rows = [(loc, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"location_id long, ts timestamp_ntz, {col} double")


def col_values(df, col, order="ts"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def same(a, b):
    assert len(a) == len(b), (a, b)
    for x, y in zip(a, b):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            assert y is None or (isinstance(y, float) and math.isnan(y)), (a, b)
        else:
            assert y is not None and abs(x - y) < 1e-9, (a, b)


GAPS = [None, 1.0, None, 3.0, 7.0, None]


@pytest.mark.parametrize("strategy", ["plain", "blocked"])
def test_fill_missing_is_ffill_bfill(spark, strategy):
    got = col_values(W.fill_missing(frame(spark, GAPS), ["x"], ["location_id"], "ts", strategy=strategy,
                                    block_rows=2), "x")
    ref = pd.Series(GAPS, dtype=float).ffill().bfill()
    same(got, ref.tolist())


def test_fill_missing_all_null_stays_null(spark):
    got = col_values(W.fill_missing(frame(spark, [None, None]), ["x"], ["location_id"], "ts"), "x")
    assert got == [None, None]


def test_rolling_matches_pandas_min_periods_1(spark):
    vals = [None, 1.0, 4.0, None, 2.0, 8.0, 3.0]
    d = W.rolling(frame(spark, vals), ["x"], 3, ("mean", "std", "min", "max"), ["location_id"], "ts", suffix="3")
    s = pd.Series(vals, dtype=float).rolling(3, min_periods=1)
    for stat, ref in (("mean", s.mean()), ("std", s.std()), ("min", s.min()), ("max", s.max())):
        same(col_values(d, f"x_rolling_{stat}_3"), [None if np.isnan(v) else v for v in ref])


def test_lag_and_change(spark):
    vals = [1.0, None, 4.0, 10.0]
    d = W.change_rate(W.lag_features(frame(spark, vals), ["x"], (1, 2), ["location_id"], "ts"), ["x"],
                      ["location_id"], "ts")
    s = pd.Series(vals, dtype=float)
    same(col_values(d, "x_lag_1"), [None if np.isnan(v) else v for v in s.shift(1)])
    same(col_values(d, "x_lag_2"), [None if np.isnan(v) else v for v in s.shift(2)])
    same(col_values(d, "x_change_rate"), [None if np.isnan(v) else v for v in s.diff()])


def test_pct_change_pads_and_nulls_division_by_zero(spark):
    vals = [1.0, None, 0.0, 0.0, 5.0, 10.0]
    got = col_values(W.change_rate_pct(frame(spark, vals), ["x"], ["location_id"], "ts"), "x_change_rate_pct")
    ref = pd.Series(vals, dtype=float).ffill().pct_change()
    # pandas gives NaN for 0/0 and inf for x/0; both are NULL here
    same(got, [None if (np.isnan(v) or np.isinf(v)) else v for v in ref])


def test_partitions_are_isolated(spark):
    a = frame(spark, [1.0, 2.0, 3.0], loc=1)
    b = frame(spark, [10.0, 20.0, 30.0], loc=2)
    d = W.lag_features(a.unionByName(b), ["x"], (1,), ["location_id"], "ts")
    got = {(r.location_id, r.ts.hour): r.x_lag_1 for r in d.collect()}
    assert got[(1, 0)] is None and got[(2, 0)] is None
    assert got[(1, 1)] == 1.0 and got[(2, 1)] == 10.0


def test_single_row(spark):
    one = frame(spark, [5.0])
    d = W.rolling(W.lag_features(one, ["x"], (1,), ["location_id"], "ts"), ["x"], 24, ("std",), ["location_id"], "ts")
    r = d.first()
    assert r.x_lag_1 is None and r.x_rolling_std_24h is None
    assert W.head_tail_trend(one.withColumnRenamed("x", "aqi"), "aqi", ["location_id"], "ts").count() == 0


def test_trend_bands(spark):
    up = frame(spark, [10.0] * 10 + [30.0] * 10, col="aqi")
    r = W.head_tail_trend(up, "aqi", ["location_id"], "ts").first()
    assert r.trend == 20.0 and r.trend_label == "worsening"


EDGES = [0.0, 50.0, 50.01, 100.0, 150.0, 200.0, 300.0, 301.0, None]


def test_category_and_alert_edges(spark):
    d = frame(spark, EDGES, col="aqi").select("ts", C.aqi_category("aqi").alias("c"), C.alert_level("aqi").alias("a"))
    cats = col_values(d, "c")
    alerts = col_values(d, "a")
    assert cats == ["Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                    "Very Unhealthy", "Hazardous", None]
    assert alerts == ["Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                      "Very Unhealthy", "Hazardous", "Hazardous", None]


def test_index_scale(spark):
    d = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 0, 9]] + [(None,)], "i int")
    got = [r[0] for r in d.select(C.aqi_index_to_scale("i")).collect()]
    assert got == [50.0, 100.0, 150.0, 200.0, 300.0, 100.0, 100.0, 100.0]


def test_calendar_dates(spark):
    days = [dt.datetime(2023, 12, 31, 5), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 29, 23),
            dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2), dt.datetime(2024, 6, 3), dt.datetime(2024, 9, 30)]
    d = FE.time_features(spark.createDataFrame([(t,) for t in days], "ts timestamp_ntz"), "ts").orderBy("ts").collect()
    pdts = pd.Series(days)
    assert [r.day_of_week for r in d] == list(pdts.dt.dayofweek)
    assert [r.is_weekend for r in d] == [int(x in (5, 6)) for x in pdts.dt.dayofweek]
    assert [r.season for r in d] == list((pdts.dt.month % 12 + 3) // 3)
    assert [r.hour for r in d] == list(pdts.dt.hour)
    for r, t in zip(d, days):
        assert abs(r.hour_sin - np.sin(2 * np.pi * t.hour / 24)) < 1e-12
        assert abs(r.day_cos - np.cos(2 * np.pi * t.day / 31)) < 1e-12


def test_numeric_coerce_dirty_text(spark):
    dirty = ["abc", " 12 ", "1e3", "12d", "NaN", "", "-3.5", None]
    d = C.numeric_coerce(spark.createDataFrame([(i, s) for i, s in enumerate(dirty)], "i int, s string"), ["s"])
    got = [r.s for r in d.orderBy("i").collect()]
    assert got == [None, 12.0, 1000.0, None, None, None, -3.5, None]


def test_row_stats(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    r = C.row_stats(d, ["a", "b", "c"], "p").collect()
    pdf = pd.DataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], columns=list("abc"), dtype=float)
    for got, (_, ref) in zip(r, pdf.iterrows()):
        same([got.p_sum, got.p_mean, got.p_std, got.p_max],
             [ref.sum(), ref.mean(), ref.std(), ref.max()])


def test_correlation_constant_is_null_and_weak(spark):
    d = spark.createDataFrame([(1, float(i), 5.0, 7.0) for i in range(5)], "location_id long, aqi double, "
                                                                          "temperature double, humidity double")
    r = I.weather_correlation(d, ["temperature", "humidity"], "aqi", ["location_id"]).first()
    assert r.temperature_corr is None and r.temperature_relation == "weak"


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = 2 * x + rng.normal(size=50)
    d = spark.createDataFrame([(1, float(a), float(b), float(b)) for a, b in zip(y, x)],
                              "location_id long, aqi double, temperature double, humidity double")
    r = I.weather_correlation(d, ["temperature"], "aqi", ["location_id"]).first()
    assert abs(r.temperature_corr - pd.Series(x).corr(pd.Series(y))) < 1e-12
    assert r.temperature_relation == "positive"


def test_best_worst_hour_ties_go_to_first(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), v) for h, v in [(3, 10.0), (5, 10.0), (7, 1.0), (9, 1.0)]]
    d = spark.createDataFrame(rows, "location_id long, ts timestamp_ntz, aqi double")
    r = I.best_worst_hour(d, ["location_id"]).first()
    assert (r.worst_hour, r.best_hour) == (3, 7)


def test_fill_mode(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, "b"), (1, "a"), (2, None)], "k long, t string")
    got = sorted((r.k, r.t) for r in W.fill_mode(d, ["t"], ["k"]).collect())
    assert got == [(1, "a"), (1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "Unknown")]


def test_safe_ratio_modes(spark):
    d = spark.createDataFrame([(2.0, 0.0), (2.0, 4.0), (2.0, None)], "a double, b double")
    r = C.safe_ratio(C.safe_ratio(d, "a", "b", "eps", "epsilon"), "a", "b", "pos", "positive").collect()
    assert r[0].pos == 0.0 and abs(r[0].eps - 2e8) < 1e-3
    assert r[1].pos == 0.5 and r[2].pos is None


def test_repartition_does_not_change_features(spark):
    from airsignal.plans.frames import obs_wide
    from tests.conftest import SF

    base = obs_wide(spark, SF)
    a = FE.all_features(base, ["location_id"], "ts")
    b = FE.all_features(base.repartition(7).orderBy(F.rand(3)), ["location_id"], "ts")
    ra = sorted(tuple(r) for r in a.collect())
    rb = sorted(tuple(r) for r in b.collect())
    assert ra == rb
