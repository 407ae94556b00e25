"""Queries for the scalar operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from airsignal.functions import columns as C
from airsignal.plans.frames import OBS_DENSE_SQL, OBS_LONG_SQL, OBS_WIDE_SQL, obs_dense, obs_long, obs_wide, table
from airsignal.plans.registry import dspec, oracle, register

TWO_PI = repr(2 * math.pi)
KEY = ["location_id", "ts"]

CAT_SQL = """CASE WHEN {c} <= 50 THEN 'Good' WHEN {c} <= 100 THEN 'Moderate'
  WHEN {c} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {c} <= 200 THEN 'Unhealthy'
  WHEN {c} <= 300 THEN 'Very Unhealthy' WHEN {c} IS NOT NULL THEN 'Hazardous' END"""
ALERT_SQL = """CASE WHEN {c} >= 300 THEN 'Hazardous' WHEN {c} >= 200 THEN 'Very Unhealthy'
  WHEN {c} >= 150 THEN 'Unhealthy' WHEN {c} >= 100 THEN 'Unhealthy for Sensitive Groups'
  WHEN {c} >= 50 THEN 'Moderate' WHEN {c} IS NOT NULL THEN 'Good' END"""


@register("aqi_index_to_scale", oracle([], """
SELECT event_id, CAST(event_id % 7 AS INTEGER) AS pollution_index,
  CASE event_id % 7 WHEN 1 THEN 50.0 WHEN 2 THEN 100.0 WHEN 3 THEN 150.0 WHEN 4 THEN 200.0
    WHEN 5 THEN 300.0 ELSE 100.0 END::DOUBLE AS aqi_scale
FROM events""", ["aqi_scale"]))
def q_aqi_index_to_scale(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("pollution_index"))
    return e.withColumn("aqi_scale", C.aqi_index_to_scale("pollution_index"))


@register("aqi_from_pollutants", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, CASE WHEN greatest(pm25 * 2.5::DOUBLE, pm10) IS NOT NULL
  THEN greatest(0.0::DOUBLE, greatest(pm25 * 2.5::DOUBLE, pm10)) END AS aqi_calc
FROM obs_wide""", ["aqi_calc"]))
def q_aqi_from_pollutants(spark, sf):
    return obs_wide(spark, sf).select(*KEY, C.aqi_from_pollutants("pm25", "pm10").alias("aqi_calc"))


@register("calendar_parts", oracle([], """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day,
  CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week
FROM events""", []))
def q_calendar_parts(spark, sf):
    return C.calendar_parts(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@register("is_weekend", oracle([], """
SELECT event_id, CAST(isodow(ts) IN (6, 7) AS INTEGER) AS is_weekend FROM events""", []))
def q_is_weekend(spark, sf):
    return table(spark, sf, "events").select("event_id", C.is_weekend("ts").alias("is_weekend"))


@register("season", oracle([], """
SELECT event_id, CAST((month(ts) % 12 + 3) // 3 AS INTEGER) AS season FROM events""", []))
def q_season(spark, sf):
    return table(spark, sf, "events").select("event_id", C.season("ts").alias("season"))


_CYC = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]


@register("cyclical", oracle([OBS_WIDE_SQL], f"""
SELECT location_id, ts,
  sin({TWO_PI}::DOUBLE * hour(ts) / 24.0::DOUBLE) AS hour_sin, cos({TWO_PI}::DOUBLE * hour(ts) / 24.0::DOUBLE) AS hour_cos,
  sin({TWO_PI}::DOUBLE * day(ts) / 31.0::DOUBLE) AS day_sin, cos({TWO_PI}::DOUBLE * day(ts) / 31.0::DOUBLE) AS day_cos,
  sin({TWO_PI}::DOUBLE * month(ts) / 12.0::DOUBLE) AS month_sin, cos({TWO_PI}::DOUBLE * month(ts) / 12.0::DOUBLE) AS month_cos
FROM obs_wide""", _CYC))
def q_cyclical(spark, sf):
    d = C.calendar_parts(obs_wide(spark, sf).select(*KEY), "ts")
    return C.cyclical(d, {"hour": 24, "day": 31, "month": 12}).select(*KEY, *_CYC)


# dirty text built from the integer in props: plain, blanks, suffix, junk, empty, exponent, NaN, decimal
_DIRTY_SQL = """CASE event_id % 8
  WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN ' ' || CAST(k AS VARCHAR) || ' '
  WHEN 2 THEN CAST(k AS VARCHAR) || 'd' WHEN 3 THEN 'abc' WHEN 4 THEN ''
  WHEN 5 THEN CAST(k AS VARCHAR) || 'e1' WHEN 6 THEN 'NaN'
  ELSE CAST(k AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) END"""


def _dirty(e):
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    m = F.col("event_id") % 8
    return (F.when(m == 0, k).when(m == 1, F.concat(F.lit(" "), k, F.lit(" ")))
            .when(m == 2, F.concat(k, F.lit("d"))).when(m == 3, F.lit("abc")).when(m == 4, F.lit(""))
            .when(m == 5, F.concat(k, F.lit("e1"))).when(m == 6, F.lit("NaN"))
            .otherwise(F.concat(k, F.lit("."), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))))


@register("numeric_coerce", oracle([], f"""
SELECT event_id, raw_text,
  CASE WHEN regexp_matches(raw_text, '{C.NUMERIC_TEXT}') THEN TRY_CAST(trim(raw_text) AS DOUBLE) END AS reading
FROM (SELECT event_id, {_DIRTY_SQL} AS raw_text
      FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))""", ["reading"]))
def q_numeric_coerce(spark, sf):
    e = table(spark, sf, "events").select("event_id", _dirty(None).alias("raw_text"))
    return C.numeric_coerce(e.withColumn("reading", F.col("raw_text")), ["reading"])


_POLY = ["temperature_squared", "temperature_cubed", "humidity_squared", "wind_speed_squared",
         "pm25_squared", "pm10_squared"]


@register("polynomial", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, temperature * temperature AS temperature_squared,
  temperature * temperature * temperature AS temperature_cubed, humidity * humidity AS humidity_squared,
  wind_speed * wind_speed AS wind_speed_squared, pm25 * pm25 AS pm25_squared, pm10 * pm10 AS pm10_squared
FROM obs_wide""", dspec(_POLY, 4)))
def q_polynomial(spark, sf):
    d = C.polynomial(obs_wide(spark, sf), {"temperature": [2, 3], "humidity": [2], "wind_speed": [2],
                                           "pm25": [2], "pm10": [2]})
    return d.select(*KEY, *_POLY)


_CS = ["temperature_centered", "humidity_scaled", "wind_speed_scaled"]


@register("center_scale", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, (temperature - 1013.25::DOUBLE) / 1013.25::DOUBLE AS temperature_centered,
  (humidity - 0.0::DOUBLE) / 10000.0::DOUBLE AS humidity_scaled, (wind_speed - 0.0::DOUBLE) / 100.0::DOUBLE AS wind_speed_scaled
FROM obs_wide""", _CS))
def q_center_scale(spark, sf):
    d = C.center_scale(obs_wide(spark, sf), {
        "temperature": (C.PRESSURE_REF, C.PRESSURE_REF, "temperature_centered"),
        "humidity": (0.0, C.VISIBILITY_SCALE, "humidity_scaled"),
        "wind_speed": (0.0, C.CLOUDS_SCALE, "wind_speed_scaled")})
    return d.select(*KEY, *_CS)


@register("direction_components", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, sin(radians(humidity)) AS humidity_sin, cos(radians(humidity)) AS humidity_cos
FROM obs_wide""", ["humidity_sin", "humidity_cos"]))
def q_direction_components(spark, sf):
    return C.direction_components(obs_wide(spark, sf), "humidity").select(*KEY, "humidity_sin", "humidity_cos")


@register("log1p_features", oracle([OBS_LONG_SQL], """
SELECT event_id, value - 50.0::DOUBLE AS shifted,
  CASE WHEN value - 50.0::DOUBLE > -1 THEN ln(1 + (value - 50.0::DOUBLE)) END AS shifted_log,
  CASE WHEN value > -1 THEN ln(1 + value) END AS value_log
FROM obs_long""", ["shifted", "shifted_log", "value_log"]))
def q_log1p_features(spark, sf):
    d = obs_long(spark, sf).select("event_id", "value", (F.col("value") - 50.0).alias("shifted"))
    return C.log1p_features(d, ["shifted", "value"]).drop("value")


_RS = ["pollutant_sum", "pollutant_mean", "pollutant_std", "pollutant_max"]
_RS_COLS = ["pm25", "pm10", "temperature", "humidity", "wind_speed"]


@register("row_stats", oracle([OBS_DENSE_SQL], f"""
SELECT location_id, ts, coalesce(list_sum(l), 0.0::DOUBLE) AS pollutant_sum, list_avg(l) AS pollutant_mean,
  list_aggregate(l, 'stddev_samp') AS pollutant_std, list_max(l) AS pollutant_max
FROM (SELECT location_id, ts, list_filter([{', '.join(_RS_COLS)}], lambda x: x IS NOT NULL) AS l FROM obs_dense)""",
    dspec(_RS, 6)))
def q_row_stats(spark, sf):
    return C.row_stats(obs_dense(spark, sf), _RS_COLS, "pollutant").select(*KEY, *_RS)


@register("interactions", oracle([OBS_DENSE_SQL], """
SELECT location_id, ts, temperature * humidity AS temp_humidity_interaction,
  wind_speed * pm25 AS wind_pm25_interaction FROM obs_dense""",
    dspec(["temp_humidity_interaction", "wind_pm25_interaction"], 6)))
def q_interactions(spark, sf):
    d = C.interactions(obs_dense(spark, sf), [("temperature", "humidity", "temp_humidity_interaction"),
                                              ("wind_speed", "pm25", "wind_pm25_interaction")])
    return d.select(*KEY, "temp_humidity_interaction", "wind_pm25_interaction")


@register("safe_ratio", oracle([OBS_DENSE_SQL], """
SELECT location_id, ts, pm25 / (pm10 + 1e-8::DOUBLE) AS pm25_pm10_ratio,
  CASE WHEN pm10 > 0 THEN pm25 / pm10 WHEN pm10 IS NOT NULL THEN 0.0::DOUBLE END AS pm25_pm10_ratio_pos
FROM obs_dense""", ["pm25_pm10_ratio", "pm25_pm10_ratio_pos"]))
def q_safe_ratio(spark, sf):
    d = C.safe_ratio(obs_dense(spark, sf), "pm25", "pm10", "pm25_pm10_ratio", "epsilon")
    d = C.safe_ratio(d, "pm25", "pm10", "pm25_pm10_ratio_pos", "positive")
    return d.select(*KEY, "pm25_pm10_ratio", "pm25_pm10_ratio_pos")


@register("aqi_category", oracle([OBS_WIDE_SQL], f"""
SELECT location_id, ts, aqi, {CAT_SQL.format(c='aqi')} AS category FROM obs_wide""", ["aqi"]))
def q_aqi_category(spark, sf):
    return obs_wide(spark, sf).select(*KEY, "aqi", C.aqi_category("aqi").alias("category"))


@register("alert_level", oracle([OBS_WIDE_SQL], f"""
SELECT location_id, ts, aqi, {ALERT_SQL.format(c='aqi')} AS alert FROM obs_wide""", ["aqi"]))
def q_alert_level(spark, sf):
    return obs_wide(spark, sf).select(*KEY, "aqi", C.alert_level("aqi").alias("alert"))


@register("clip_floor", oracle([OBS_LONG_SQL], """
SELECT event_id, greatest(0.0::DOUBLE, value - 100.0::DOUBLE) AS clipped FROM obs_long""", ["clipped"]))
def q_clip_floor(spark, sf):
    return obs_long(spark, sf).select("event_id", C.clip_floor(F.col("value") - 100.0).alias("clipped"))


def _attr_sql(c: str) -> str:
    col = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORY_COLORS.items())
    icon = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.CATEGORY_ADVICE.items())
    msg = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.CATEGORY_ADVICE.items())
    act = " ".join(f"WHEN '{k}' THEN '{'; '.join(v[2])}'" for k, v in C.CATEGORY_ADVICE.items())
    good = C.CATEGORY_ADVICE["Good"]
    return (f"CASE {c} {col} ELSE '{C.UNKNOWN_COLOR}' END AS color, CASE {c} {icon} ELSE '{good[0]}' END AS icon, "
            f"CASE {c} {msg} ELSE '{good[1]}' END AS message, "
            f"CASE {c} {act} ELSE '{'; '.join(good[2])}' END AS actions")


@register("category_attributes", oracle([OBS_WIDE_SQL], f"""
SELECT location_id, ts, category, {_attr_sql('category')}
FROM (SELECT location_id, ts, {CAT_SQL.format(c='aqi')} AS category FROM obs_wide)""", []))
def q_category_attributes(spark, sf):
    d = obs_wide(spark, sf).select(*KEY, C.aqi_category("aqi").alias("category"))
    return C.category_attributes(d, "category").withColumn("actions", F.array_join("actions", "; "))
