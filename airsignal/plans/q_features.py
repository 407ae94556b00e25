"""Queries for the feature blocks and the full feature table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from airsignal.operators import features as FE
from airsignal.plans.frames import OBS_DENSE_SQL, OBS_WIDE_SQL, SERIES, obs_dense, obs_wide
from airsignal.plans.registry import oracle, register

K = ["location_id"]
KEY = ["location_id", "ts"]
TP = repr(2 * math.pi)
WSQL = "PARTITION BY location_id ORDER BY ts"
RUN = f"OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ALL = f"OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

TIME_SQL = (f"CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, "
            f"CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) IN (6, 7) AS INTEGER) AS is_weekend, "
            f"CAST((month(ts) % 12 + 3) // 3 AS INTEGER) AS season, "
            f"sin({TP}::DOUBLE * hour(ts) / 24.0::DOUBLE) AS hour_sin, cos({TP}::DOUBLE * hour(ts) / 24.0::DOUBLE) AS hour_cos, "
            f"sin({TP}::DOUBLE * day(ts) / 31.0::DOUBLE) AS day_sin, cos({TP}::DOUBLE * day(ts) / 31.0::DOUBLE) AS day_cos, "
            f"sin({TP}::DOUBLE * month(ts) / 12.0::DOUBLE) AS month_sin, cos({TP}::DOUBLE * month(ts) / 12.0::DOUBLE) AS month_cos")
TIME_DBL = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]


def _digits(cols):
    big = ("_squared", "_cubed", "_interaction")
    return {c: (4 if c.endswith(big) else 6) for c in cols}


def _row_stats_sql(cols, prefix):
    lst = f"list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL)"
    return (f"coalesce(list_sum({lst}), 0.0::DOUBLE) AS {prefix}_sum, list_avg({lst}) AS {prefix}_mean, "
            f"list_aggregate({lst}, 'stddev_samp') AS {prefix}_std, list_max({lst}) AS {prefix}_max")


def _derived_sql(src: str, series: list[str], have: set[str]) -> tuple[str, list[str]]:
    """SQL of the derived block over ``src`` (which has the base columns); returns (ctes, new column names)."""
    names, ex = [], []
    for c in series:
        for k in (1, 2, 3):
            names.append(f"{c}_lag_{k}")
            ex.append(f"lag({c}, {k}) OVER ({WSQL}) AS {c}_lag_{k}")
    for c in series:
        names.append(f"{c}_change_rate")
        ex.append(f"{c} - lag({c}, 1) OVER ({WSQL}) AS {c}_change_rate")
    for c in series:
        names.append(f"{c}_change_rate_pct")
        ex.append(f"f_{c} / nullif(lag(f_{c}, 1) OVER ({WSQL}), 0) - 1 AS {c}_change_rate_pct")
    for rows, stats, sfx in ((24, ("mean", "std", "min", "max"), "24h"), (168, ("mean", "std"), "7d")):
        for c in series:
            for s in stats:
                names.append(f"{c}_rolling_{s}_{sfx}")
                ex.append(f"{SQL_STAT[s]}({c}) OVER ({WSQL} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW) "
                          f"AS {c}_rolling_{s}_{sfx}")
    if {"temperature", "humidity"} <= have:
        names.append("temp_humidity_interaction")
        ex.append("temperature * humidity AS temp_humidity_interaction")
    if {"pm25", "pm10"} <= have:
        names.append("pm25_pm10_ratio")
        ex.append("pm25 / (pm10 + 1e-8::DOUBLE) AS pm25_pm10_ratio")
    if {"wind_speed", "pm25"} <= have:
        names.append("wind_pm25_interaction")
        ex.append("wind_speed * pm25 AS wind_pm25_interaction")
    ff = ", ".join(f"last_value({c} IGNORE NULLS) {RUN} AS f_{c}" for c in series)
    excl = ", ".join(f"f_{c}" for c in series)
    ctes = (f"d_ff AS (SELECT *, {ff} FROM {src}),\n"
            f"d_out AS (SELECT * EXCLUDE ({excl}), {', '.join(ex)} FROM d_ff)")
    return ctes, names


@register("time_features", oracle([OBS_WIDE_SQL], f"SELECT location_id, ts, {TIME_SQL} FROM obs_wide", TIME_DBL))
def q_time_features(spark, sf):
    return FE.time_features(obs_wide(spark, sf).select(*KEY), "ts")


_WX = ["temperature_squared", "temperature_cubed", "humidity_squared", "pressure_normalized", "wind_speed_squared",
       "wind_direction_sin", "wind_direction_cos"]


@register("weather_features", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, temperature * temperature AS temperature_squared,
  temperature * temperature * temperature AS temperature_cubed, humidity * humidity AS humidity_squared,
  (pressure - 1013.25::DOUBLE) / 1013.25::DOUBLE AS pressure_normalized, wind_speed * wind_speed AS wind_speed_squared,
  sin(radians(wind_direction)) AS wind_direction_sin, cos(radians(wind_direction)) AS wind_direction_cos
FROM (SELECT *, temperature + 950.0::DOUBLE AS pressure, humidity AS wind_direction FROM obs_wide)""", _digits(_WX)))
def q_weather_features(spark, sf):
    d = obs_wide(spark, sf).withColumns({"pressure": F.col("temperature") + 950.0, "wind_direction": F.col("humidity")})
    return FE.weather_features(d).select(*KEY, *_WX)


_PL_BASE = ["pm25", "pm10", "o3", "no2", "so2"]
_PL = [f"{c}_{s}" for c in _PL_BASE for s in ("squared", "log")] + \
    ["pollutant_sum", "pollutant_mean", "pollutant_std", "pollutant_max"]


@register("pollutant_features", oracle([OBS_DENSE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"{c} * {c} AS {c}_squared, CASE WHEN {c} > -1 THEN ln(1 + {c}) END AS {c}_log" for c in _PL_BASE)
    + ", " + _row_stats_sql(_PL_BASE, "pollutant")
    + " FROM (SELECT *, temperature AS o3, humidity AS no2, wind_speed AS so2 FROM obs_dense)", _digits(_PL)))
def q_pollutant_features(spark, sf):
    d = obs_dense(spark, sf).withColumns({"o3": F.col("temperature"), "no2": F.col("humidity"),
                                          "so2": F.col("wind_speed")})
    return FE.pollutant_features(d).select(*KEY, *_PL)


_DV_CTES, _DV = _derived_sql("obs_wide", SERIES, set(SERIES))


@register("derived_features", oracle([OBS_WIDE_SQL, _DV_CTES],
                                     "SELECT location_id, ts, " + ", ".join(_DV) + " FROM d_out", _digits(_DV)))
def q_derived_features(spark, sf):
    d = FE.derived_features(obs_wide(spark, sf).select(*KEY, *SERIES), K, "ts", include_target=True)
    return d.select(*KEY, *_DV)


# the blocked plan: locations divisible by seven have no key and are one series; of their readings of one hour one is kept
_BLOCKED_SQL = OBS_WIDE_SQL.replace("obs_wide AS (", "obs_keyed AS (").replace("obs_wide_p", "obs_wide_p") + """,
obs_wide AS (SELECT * REPLACE (CASE WHEN location_id % 7 = 0 THEN NULL ELSE location_id END AS location_id) FROM obs_keyed
  WHERE location_id % 7 <> 0 OR location_id IN (SELECT min(location_id) FROM obs_keyed k WHERE k.location_id % 7 = 0 AND k.ts = obs_keyed.ts))"""


def _null_keys(spark, sf):
    d = obs_wide(spark, sf)
    none = F.col("location_id") % 7 == 0
    least = d.filter(none).groupBy("ts").agg(F.min("location_id").alias("least"))
    d = d.join(least, "ts", "left").filter(~none | (F.col("location_id") == F.col("least"))).drop("least")
    return d.select(F.when(~none, F.col("location_id")).alias("location_id"), *[c for c in d.columns if c != "location_id"])


@register("derived_features_blocked", oracle([_BLOCKED_SQL, _DV_CTES],
                                             "SELECT location_id, ts, " + ", ".join(_DV) + " FROM d_out", _digits(_DV)))
def q_derived_features_blocked(spark, sf):
    """In blocks of 200 rows, a seventh of the locations without a key, as one series."""
    d = _null_keys(spark, sf).select(*KEY, *SERIES)
    return FE.derived_features(d, K, "ts", include_target=True, strategy="blocked", block_rows=200).select(*KEY, *_DV)


def _all_features_sql(src=OBS_WIDE_SQL):
    base = ["pm25", "pm10", "temperature", "humidity", "wind_speed", "aqi"]
    scal = ["temperature_squared", "temperature_cubed", "humidity_squared", "wind_speed_squared",
            "pm25_squared", "pm25_log", "pm10_squared", "pm10_log",
            "pollutant_sum", "pollutant_mean", "pollutant_std", "pollutant_max"]
    s1 = ("af1 AS (SELECT location_id, ts, " + ", ".join(base) + ", " + TIME_SQL + ", "
          "temperature * temperature AS temperature_squared, temperature * temperature * temperature AS temperature_cubed, "
          "humidity * humidity AS humidity_squared, wind_speed * wind_speed AS wind_speed_squared, "
          "pm25 * pm25 AS pm25_squared, CASE WHEN pm25 > -1 THEN ln(1 + pm25) END AS pm25_log, "
          "pm10 * pm10 AS pm10_squared, CASE WHEN pm10 > -1 THEN ln(1 + pm10) END AS pm10_log, "
          + _row_stats_sql(["pm25", "pm10"], "pollutant") + " FROM obs_wide)")
    series = ["temperature", "humidity", "wind_speed", "pm25", "pm10"]
    dctes, dnames = _derived_sql("af1", series, set(base))
    fill = [*base, *scal, *dnames]
    time_cols = FE.TIME_COLS
    body = ("SELECT location_id, ts, " + ", ".join(time_cols) + ", " + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) {RUN}, first_value({c} IGNORE NULLS) {ALL}) AS {c}" for c in fill)
        + " FROM d_out")
    cols = [*fill, *TIME_DBL]
    return oracle([src, s1, dctes], body, _digits(cols))


@register("all_features", _all_features_sql())
def q_all_features(spark, sf):
    return FE.all_features(obs_wide(spark, sf), K, "ts", "aqi")


@register("all_features_blocked", _all_features_sql(_BLOCKED_SQL))
def q_all_features_blocked(spark, sf):
    return FE.all_features(_null_keys(spark, sf), K, "ts", "aqi", strategy="blocked", block_rows=200)


@register("select_features", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, pm25, pm10, temperature, humidity, wind_speed, aqi FROM obs_wide""", SERIES))
def q_select_features(spark, sf):
    d = obs_wide(spark, sf).withColumns({"source": F.lit("events"), "aqi_openweather": F.col("aqi")})
    return FE.select_features(d, "aqi", keep=KEY)


@register("align_columns", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, pm25, 0.0::DOUBLE AS o3, temperature, 0.0::DOUBLE AS clouds FROM obs_wide""",
    ["pm25", "o3", "temperature", "clouds"]))
def q_align_columns(spark, sf):
    return FE.align_columns(obs_wide(spark, sf), ["pm25", "o3", "temperature", "clouds"], keep=KEY)


@register("resolve_target", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, aqi AS aqi_openweather, aqi FROM obs_wide""", ["aqi_openweather", "aqi"]))
def q_resolve_target(spark, sf):
    d = obs_wide(spark, sf).select(*KEY, F.col("aqi").alias("aqi_openweather"))
    return FE.resolve_target(d, "aqi")


@register("time_range_filter", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, aqi FROM obs_wide
WHERE ts >= (SELECT max(ts) FROM obs_wide) - INTERVAL 72 HOUR""", ["aqi"]))
def q_time_range_filter(spark, sf):
    return FE.time_range_filter(obs_wide(spark, sf).select(*KEY, "aqi"), "ts", 72)
