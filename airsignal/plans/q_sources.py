"""Queries for feed parsing, merging and flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from airsignal.plans import landing as LD
from airsignal.plans.landing import EPOCH_SQL, K_SQL
from airsignal.plans.registry import oracle, register
from airsignal.sources import parse as P
from airsignal.sources.schemas import SECOND_MEASURES

TS = "make_timestamp(({e}) * 1000000)"
SCALE = "CASE {c} WHEN 1 THEN 50.0 WHEN 2 THEN 100.0 WHEN 3 THEN 150.0 WHEN 4 THEN 200.0 WHEN 5 THEN 300.0 ELSE 100.0 END::DOUBLE"

_WX = ["temperature", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds"]


def _with_rejected(good, rejected):
    return (good.withColumns({"status": F.lit("ok"), "reason": F.lit(None).cast("string")})
            .unionByName(rejected.drop("raw").withColumn("status", F.lit("rejected")), allowMissingColumns=True))


def _rejected_sql(good: str, columns: str) -> str:
    """Good rows of the sound documents, and a row per broken one."""
    return (f"SELECT *, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM ({good} WHERE NOT {LD.BROKEN_SQL})\n"
            f"UNION ALL BY NAME SELECT {columns}, 'rejected' AS status, 'unparsable document' AS reason "
            f"FROM events WHERE {LD.BROKEN_SQL}")


_WEATHER_SQL = f"""
SELECT user_id AS location_id, event_id, ts, value AS temperature, value - 1 AS feels_like, {K_SQL} AS humidity,
  1000.0::DOUBLE + event_id % 30 AS pressure, value / 10 AS wind_speed,
  CASE WHEN event_type <> 'click' THEN CAST(event_id % 360 AS DOUBLE) ELSE 0.0::DOUBLE END AS wind_direction,
  event_type AS description, '0' || CAST(event_id % 9 AS VARCHAR) || 'd' AS icon,
  CASE WHEN event_type <> 'view' THEN CAST(10000 - event_id % 5000 AS DOUBLE) ELSE 0.0::DOUBLE END AS visibility,
  CAST(event_id % 101 AS DOUBLE) AS clouds,
  {TS.format(e=EPOCH_SQL + ' - 21600')} AS sunrise, {TS.format(e=EPOCH_SQL + ' + 21600')} AS sunset
FROM events"""
_WHO = "user_id AS location_id, event_id, ts"


@register("parse_weather", oracle([], _rejected_sql(_WEATHER_SQL, _WHO), _WX))
def q_parse_weather(spark, sf):
    return _with_rejected(*P.parse_weather(LD.weather_docs(spark, sf, broken=True), "json"))


_PL = ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co", "nh3"]
_POLLUTION_SQL = f"""
SELECT user_id AS location_id, event_id, ts, {TS.format(e=EPOCH_SQL)} AS pollution_ts,
  {SCALE.format(c='event_id % 7')} AS aqi, value AS pm25,
  CASE WHEN event_type <> 'signup' THEN value * 2 ELSE 0.0::DOUBLE END AS pm10, {K_SQL} AS o3, value / 2 AS no2,
  CASE WHEN event_id % 3 <> 0 THEN {K_SQL} / 3 ELSE 0.0::DOUBLE END AS so2, value * 10 AS co,
  CASE WHEN event_type = 'error' THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS nh3
FROM events"""


@register("parse_pollution", oracle([], _rejected_sql(_POLLUTION_SQL, _WHO), _PL))
def q_parse_pollution(spark, sf):
    return _with_rejected(*P.parse_pollution(LD.pollution_docs(spark, sf, broken=True), "json"))


_SECOND_SQL = {"pm25": "value", "pm10": K_SQL, "o3": "CASE WHEN event_id % 4 <> 0 THEN value / 3 ELSE 0.0 END",
               "no2": "value / 5", "so2": "0.0", "co": "value * 2", "t": "value / 4", "h": f"{K_SQL} / 2",
               "p": "1013.0", "w": "CASE WHEN event_id % 5 <> 0 THEN value / 20 ELSE 0.0 END", "wg": "0.0"}


@register("parse_second_source", oracle([], "SELECT user_id AS location_id, event_id, ts, "
    "CASE WHEN event_id % 97 = 0 OR event_id % 10 = 0 THEN 'rejected' ELSE 'ok' END AS status, "
    "CASE WHEN event_id % 97 = 0 THEN 'unparsable document' WHEN event_id % 10 = 0 "
    "THEN 'source error: Unknown station' END AS reason, "
    "CASE WHEN event_id % 97 <> 0 AND event_id % 10 <> 0 THEN value * 1.5 END AS aqi, " + ", ".join(
        f"CASE WHEN event_id % 97 <> 0 AND event_id % 10 <> 0 THEN CAST({e} AS DOUBLE) END AS {n}"
        for n, e in _SECOND_SQL.items()) + " FROM events", ["aqi", *SECOND_MEASURES]))
def q_parse_second_source(spark, sf):
    return _with_rejected(*P.parse_second_source(LD.second_docs(spark, sf), "json"))


_FC = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "clouds", "pop"]


_FORECAST_SQL = f"""
SELECT user_id AS location_id, event_id, CAST(i AS INTEGER) AS step, {TS.format(e=EPOCH_SQL + ' + i * 10800')} AS ts,
  value + i AS temperature, {K_SQL} AS humidity, 1000.0::DOUBLE + i AS pressure, value / 10 AS wind_speed,
  CASE WHEN i <> 1 THEN CAST(i * 90 AS DOUBLE) ELSE 0.0::DOUBLE END AS wind_direction, event_type AS description,
  '01d' AS icon, CAST(i * 10 AS DOUBLE) AS clouds, CASE WHEN i = 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pop
FROM events CROSS JOIN range(0, 3) AS g(i)"""


@register("explode_forecast", oracle([], _rejected_sql(_FORECAST_SQL, "user_id AS location_id, event_id"), _FC))
def q_explode_forecast(spark, sf):
    return _with_rejected(*P.explode_forecast(LD.forecast_docs(spark, sf, broken=True), "json"))


def merged(spark, sf):
    keys = ["location_id", "event_id"]
    w, _ = P.parse_weather(LD.weather_docs(spark, sf), "json")
    p, _ = P.parse_pollution(LD.pollution_docs(spark, sf).drop("ts"), "json")
    good, _ = P.parse_second_source(LD.second_docs(spark, sf).drop("ts"), "json")
    return P.merge_sources(w, p, good, keys, "ts")


_MERGED_SQL = f"""m AS (SELECT user_id AS location_id, event_id, ts, value AS temperature, {K_SQL} AS humidity,
  1000.0::DOUBLE + event_id % 30 AS pressure, value / 10 AS wind_speed,
  CASE WHEN event_type <> 'click' THEN CAST(event_id % 360 AS DOUBLE) ELSE 0.0::DOUBLE END AS wind_direction,
  CASE WHEN event_type <> 'view' THEN CAST(10000 - event_id % 5000 AS DOUBLE) ELSE 0.0::DOUBLE END AS visibility,
  CAST(event_id % 101 AS DOUBLE) AS clouds,
  {SCALE.format(c='event_id % 7')} AS p_aqi, value AS p_pm25,
  CASE WHEN event_type <> 'signup' THEN value * 2 ELSE 0.0::DOUBLE END AS p_pm10, {K_SQL} AS p_o3,
  value / 2 AS p_no2, CASE WHEN event_id % 3 <> 0 THEN {K_SQL} / 3 ELSE 0.0::DOUBLE END AS p_so2, value * 10 AS p_co,
  event_id % 97 <> 0 AND event_id % 10 <> 0 AS has_second
FROM events)"""


@register("merge_sources", oracle([_MERGED_SQL], """
SELECT location_id, event_id, ts, temperature, p_aqi AS pollution_aqi, p_pm25 AS pollution_pm25,
  CASE WHEN has_second THEN temperature * 1.5 ELSE p_aqi END AS second_aqi,
  CASE WHEN has_second THEN temperature ELSE p_pm25 END AS second_pm25,
  CASE WHEN has_second THEN 0.0::DOUBLE ELSE p_so2 END AS second_so2,
  CASE WHEN has_second THEN ts ELSE {pts} END AS second_ts, 'data_collector' AS source
FROM m""".replace("{pts}", TS.format(e=EPOCH_SQL)), ["temperature", "pollution_aqi", "pollution_pm25", "second_aqi", "second_pm25", "second_so2"]))
def q_merge_sources(spark, sf):
    m = merged(spark, sf)
    return m.select("location_id", "event_id", "ts", F.col("weather.temperature").alias("temperature"),
                    F.col("pollution.aqi").alias("pollution_aqi"), F.col("pollution.pm25").alias("pollution_pm25"),
                    F.col("second_source.aqi").alias("second_aqi"), F.col("second_source.pm25").alias("second_pm25"),
                    F.col("second_source.so2").alias("second_so2"), F.col("second_source.ts").alias("second_ts"),
                    "source")


@register("merge_sources_without_second", oracle([_MERGED_SQL], """
SELECT location_id, event_id, ts, temperature, p_aqi AS second_aqi, p_pm25 AS second_pm25, p_so2 AS second_so2, {pts} AS second_ts
FROM m""".replace("{pts}", TS.format(e=EPOCH_SQL)), ["temperature", "second_aqi", "second_pm25", "second_so2"]))
def q_merge_sources_without_second(spark, sf):
    w, _ = P.parse_weather(LD.weather_docs(spark, sf), "json")
    p, _ = P.parse_pollution(LD.pollution_docs(spark, sf).drop("ts"), "json")
    m = P.merge_sources(w, p, None, ["location_id", "event_id"], "ts")
    return m.select("location_id", "event_id", "ts", F.col("weather.temperature").alias("temperature"),
                    F.col("second_source.aqi").alias("second_aqi"), F.col("second_source.pm25").alias("second_pm25"),
                    F.col("second_source.so2").alias("second_so2"), F.col("second_source.ts").alias("second_ts"))


_FLAT = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds",
         "aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]


@register("flatten_defaults", oracle([_MERGED_SQL], """
SELECT location_id, event_id, ts, temperature, humidity, pressure, wind_speed, wind_direction, visibility, clouds,
  p_aqi AS aqi, p_pm25 AS pm25, p_pm10 AS pm10, p_o3 AS o3, p_no2 AS no2, p_so2 AS so2, p_co AS co FROM m""", _FLAT))
def q_flatten_defaults(spark, sf):
    return P.flatten_defaults(merged(spark, sf))


@register("flatten_nested", oracle([_MERGED_SQL], """
SELECT location_id, event_id, ts, temperature, temperature - 1 AS feels_like, humidity, pressure, wind_speed,
  wind_direction, visibility, clouds, p_pm25 AS pm25, p_pm10 AS pm10, p_o3 AS o3, p_no2 AS no2, p_so2 AS so2,
  p_co AS co, p_aqi AS aqi_openweather, CASE WHEN has_second THEN temperature * 1.5 ELSE p_aqi END AS aqi_aqicn,
  'data_collector' AS source FROM m""",
    ["temperature", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds",
     "pm25", "pm10", "o3", "no2", "so2", "co", "aqi_openweather", "aqi_aqicn"]))
def q_flatten_nested(spark, sf):
    return P.flatten_nested(merged(spark, sf))
