"""Reading frames derived from the given tables.

``events(event_id, ts, user_id, event_type, value, props)`` is read as a stream
of sensor readings: ``user_id`` is the location, ``event_type`` the measure.

* ``obs_wide``  — one row per (location, hour): hourly mean per measure, plus
  ``aqi = greatest(2.5 * pm25, pm10)``. Sparse: most rows hold one measure.
* ``obs_dense`` — the same with ``user_id % 3`` as location: dense rows.
* ``obs_long``  — the raw readings, one row per event.

The pivot is one hash aggregate with map-side partial aggregation: a hot
location is spread over its many (location, hour) groups, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed mapping of test-table event types to measures.
MEASURES = {
    "click": "pm25",
    "view": "pm10",
    "purchase": "temperature",
    "signup": "humidity",
    "error": "wind_speed",
}
SERIES = ["aqi", "temperature", "humidity", "wind_speed", "pm25", "pm10"]
WIDE_COLS = ["pm25", "pm10", "temperature", "humidity", "wind_speed", "aqi"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pivot(events: DataFrame, location: Column) -> DataFrame:
    e = events.select("user_id", "ts", "event_type", "value")
    hourly = e.groupBy(location.alias("location_id"), F.date_trunc("hour", "ts").alias("ts")).agg(
        *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(m) for t, m in MEASURES.items()]
    )
    return hourly.withColumn("aqi", F.greatest(F.col("pm25") * F.lit(2.5), F.col("pm10")))


def obs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivot(table(spark, sf_dir, "events"), F.col("user_id"))


def obs_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivot(table(spark, sf_dir, "events"), F.col("user_id") % 3)


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("location_id"), "event_id", "ts",
        F.col("event_type").alias("measure"), "value")


# The same frames in SQL (DuckDB / ANSI), used by the oracle queries.
def _pivot_sql(name: str, location: str) -> str:
    cols = ",\n    ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {m}" for t, m in MEASURES.items())
    return (f"{name}_p AS (\n  SELECT {location} AS location_id, date_trunc('hour', ts) AS ts,\n    {cols}\n"
            f"  FROM events GROUP BY 1, 2),\n"
            f"{name} AS (SELECT *, greatest(pm25 * 2.5::DOUBLE, pm10) AS aqi FROM {name}_p)")


OBS_WIDE_SQL = _pivot_sql("obs_wide", "user_id")
OBS_DENSE_SQL = _pivot_sql("obs_dense", "user_id % 3")
OBS_LONG_SQL = ("obs_long AS (SELECT user_id AS location_id, event_id, ts, event_type AS measure, value "
                "FROM events)")
