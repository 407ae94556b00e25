"""Queries for stores, spine/grid, location catalogue and run logs.

Write queries write into a fresh folder below the session's checkpoint
directory and return what they read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airsignal.operators import insights as I
from airsignal.plans.frames import OBS_WIDE_SQL, SERIES, obs_wide, table
from airsignal.plans.q_sources import _FLAT, _MERGED_SQL, merged
from airsignal.plans.registry import oracle, register
from airsignal.session import scratch_path
from airsignal.sources import grid as G
from airsignal.sources import locations as LOC
from airsignal.sources import parse as P
from airsignal.sources import runlog as RL
from airsignal.sources import store as ST

K = ["location_id"]
KEY = ["location_id", "ts"]

_FLAT_SQL = """SELECT location_id, event_id, ts, temperature, humidity, pressure, wind_speed, wind_direction,
  visibility, clouds, p_aqi AS aqi, p_pm25 AS pm25, p_pm10 AS pm10, p_o3 AS o3, p_no2 AS no2, p_so2 AS so2, p_co AS co
FROM m"""


@register("raw_append", oracle([_MERGED_SQL], _FLAT_SQL, _FLAT))
def q_raw_append(spark, sf):
    path = scratch_path(spark, "raw")
    ST.raw_append(merged(spark, sf), path, keys=["location_id", "event_id"])
    back = ST.raw_range_scan(spark, path)
    return P.flatten_defaults(back.drop("ingested_at", "event_date"))


@register("raw_append_json", oracle([_MERGED_SQL], _FLAT_SQL, _FLAT))
def q_raw_append_json(spark, sf):
    path = scratch_path(spark, "raw")
    ST.raw_append(merged(spark, sf), path, keys=["location_id", "event_id"], as_json=True)
    back = ST.raw_range_scan(spark, path, newest_first=True)
    return P.flatten_defaults(back.drop("ingested_at", "event_date"))


@register("raw_range_scan", oracle([_MERGED_SQL], _FLAT_SQL + """
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 72 HOUR""", _FLAT))
def q_raw_range_scan(spark, sf):
    path = scratch_path(spark, "raw")
    ST.raw_append(merged(spark, sf), path, keys=["location_id", "event_id"])
    back = ST.raw_range_scan(spark, path, hours=72, as_of="2024-01-30 00:00:00")
    return P.flatten_defaults(back.drop("ingested_at", "event_date"))


_FEAT_SQL = ("SELECT location_id, ts, " + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in SERIES if c != "aqi")
             + ", coalesce(aqi, 50.0::DOUBLE) AS aqi FROM obs_wide")
_FEATS = [c for c in SERIES if c != "aqi"]


@register("feature_write", oracle([OBS_WIDE_SQL], _FEAT_SQL, SERIES))
def q_feature_write(spark, sf):
    path = scratch_path(spark, "features")
    ST.feature_write(obs_wide(spark, sf), path, "aqi", K, "ts")
    return ST.feature_read(spark, path, columns=_FEATS)


@register("feature_read", oracle([OBS_WIDE_SQL], _FEAT_SQL + """
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR""", SERIES))
def q_feature_read(spark, sf):
    path = scratch_path(spark, "features")
    ST.feature_write(obs_wide(spark, sf), path, "aqi", K, "ts")
    return ST.feature_read(spark, path, hours=48, as_of="2024-01-30 00:00:00", columns=_FEATS)


@register("feature_write_json", oracle([OBS_WIDE_SQL], _FEAT_SQL, SERIES))
def q_feature_write_json(spark, sf):
    path = scratch_path(spark, "features")
    ST.feature_write(obs_wide(spark, sf), path, "aqi", K, "ts", as_json=True)
    return ST.feature_read(spark, path, columns=_FEATS)


@register("feature_merge", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"CASE WHEN location_id % 4 = 0 THEN 2 ELSE 1 END * coalesce({c}, 0.0::DOUBLE) AS {c}" for c in SERIES if c != "aqi")
    + ", coalesce(aqi, 50.0::DOUBLE) AS aqi FROM obs_wide", SERIES))
def q_feature_merge(spark, sf):
    """Two writes into the same dates: two thirds of the rows, then the rest and new values of a quarter of the locations."""
    path, d = scratch_path(spark, "features"), obs_wide(spark, sf)
    late = F.pmod(F.xxhash64(*KEY), F.lit(3)) == 0
    ST.feature_write(d.filter(~late), path, "aqi", K, "ts", mode="merge")
    again = d.withColumns({c: F.when(F.col("location_id") % 4 == 0, F.col(c) * 2).otherwise(F.col(c)) for c in _FEATS})
    ST.feature_write(again.filter(late | (F.col("location_id") % 4 == 0)), path, "aqi", K, "ts", mode="merge")
    return ST.feature_read(spark, path, columns=_FEATS)


@register("store_status", oracle([OBS_WIDE_SQL], """
SELECT 'raw_data' AS table_name, count(*) AS records, max(ts) AS latest_ts,
  CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM events
UNION ALL
SELECT 'features', count(*), max(ts), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM obs_wide""", []))
def q_store_status(spark, sf):
    return ST.store_status(table(spark, sf, "events"), obs_wide(spark, sf), "ts")


@register("hourly_spine", oracle([OBS_WIDE_SQL], """
SELECT location_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
FROM obs_wide GROUP BY location_id""", []))
def q_hourly_spine(spark, sf):
    b = obs_wide(spark, sf).groupBy("location_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return G.hourly_spine(b, "start", "end", 3600, keep=K)


@register("regularize", oracle([OBS_WIDE_SQL, """spine AS (
  SELECT location_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM obs_wide GROUP BY location_id)"""], """
SELECT s.location_id, s.ts, """ + ", ".join(f"o.{c}" for c in SERIES) + """
FROM spine s LEFT JOIN obs_wide o ON s.location_id = o.location_id AND s.ts = o.ts""", SERIES))
def q_regularize(spark, sf):
    return G.regularize(obs_wide(spark, sf).select(*KEY, *SERIES), K, "ts", 3600, SERIES)


def catalogue(spark, sf):
    """Regions as countries, nations as their cities (coordinates derived from the keys)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    city = F.struct((F.col("n_nationkey") * 3.5 - 40.0).alias("latitude"),
                    (F.col("n_nationkey") * 7.0 - 90.0).alias("longitude"), F.lit("UTC").alias("timezone"))
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .groupBy(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("country_code"),
                     F.col("r_name").alias("name"))
            .agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), city))).alias("cities")))


_DIM_SQL = """dim AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS country_code, r_name AS country_name,
  n_name AS city, n_nationkey * 3.5::DOUBLE - 40.0::DOUBLE AS latitude, n_nationkey * 7.0::DOUBLE - 90.0::DOUBLE AS longitude,
  'UTC' AS timezone, 'R' || CAST(r_regionkey AS VARCHAR) || '/' || n_name AS location_id
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@register("location_dim", oracle([_DIM_SQL], "SELECT * FROM dim", ["latitude", "longitude"]))
def q_location_dim(spark, sf):
    return LOC.location_dim(catalogue(spark, sf))


@register("countries", oracle([_DIM_SQL], "SELECT DISTINCT country_code, country_name FROM dim", []))
def q_countries(spark, sf):
    return LOC.countries(LOC.location_dim(catalogue(spark, sf)))


@register("cities", oracle([_DIM_SQL], "SELECT city FROM dim WHERE country_code = 'R3'", []))
def q_cities(spark, sf):
    return LOC.cities(LOC.location_dim(catalogue(spark, sf)), "R3")


@register("location_lookup", oracle([_DIM_SQL], """
SELECT c.c_custkey, d.city, d.country_name, d.latitude, d.longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN dim d ON d.city = n.n_name""",
    ["latitude", "longitude"]))
def q_location_lookup(spark, sf):
    cust = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey", "n_name"),
                                             F.col("c_nationkey") == F.col("n_nationkey"))
    dim = LOC.location_dim(catalogue(spark, sf)).select(F.col("city").alias("n_name"), "city", "country_name",
                                                       "latitude", "longitude")
    return LOC.location_lookup(cust.select("c_custkey", "n_name"), dim, "n_name").drop("n_name")


@register("run_history", oracle([OBS_WIDE_SQL, """ev AS (SELECT location_id, aqi AS y,
  lag(aqi, 1) OVER (PARTITION BY location_id ORDER BY ts) AS p FROM obs_wide)"""], """
SELECT 'model_' || CAST(location_id AS VARCHAR) AS model_name, '2024-02-01T00:00:00' AS run_ts,
  CASE WHEN location_id % 2 = 0 THEN avg((y - p) * (y - p)) END AS mse,
  sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1.0::DOUBLE - sum((y - p) * (y - p)) / nullif(var_pop(CASE WHEN p IS NOT NULL THEN y END) * count(y - p), 0) AS r2,
  avg(abs((y - p) / CASE WHEN y <> 0 THEN y END)) * 100.0::DOUBLE AS mape,
  CASE WHEN location_id % 2 = 0 THEN 0 ELSE 2 END AS n_features
FROM ev GROUP BY location_id""", ["mse", "rmse", "mae", "r2", "mape"]))
def q_run_history(spark, sf):
    from pyspark.sql import Window
    d = obs_wide(spark, sf)
    ev = d.select("location_id", F.col("aqi").alias("label"),
                  F.lag("aqi", 1).over(Window.partitionBy("location_id").orderBy("ts")).alias("prediction"))
    res = I.evaluate(ev, "label", "prediction", K)
    old = F.col("location_id") % 2 == 0
    runs = res.select(F.concat(F.lit("model_"), F.col("location_id").cast("string")).alias("model_name"),
                      F.lit("2024-02-01T00:00:00").alias("timestamp"),
                      F.when(old, F.col("rmse") * F.col("rmse")).alias("mse"), "rmse", "mae", "r2", "mape",
                      F.when(old, F.array().cast("array<string>"))
                      .otherwise(F.array(F.lit("pm25"), F.lit("pm10"))).alias("feature_columns"))
    path = scratch_path(spark, "runs")
    RL.write_run_logs(runs, path)
    return RL.run_history(spark, path)
