"""Queries for insights, ranking and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from airsignal.functions import columns as C
from airsignal.operators import insights as I
from airsignal.plans.frames import OBS_DENSE_SQL, OBS_LONG_SQL, OBS_WIDE_SQL, SERIES, obs_dense, obs_long, obs_wide
from airsignal.plans.q_columns import CAT_SQL
from airsignal.plans.registry import oracle, register

K = ["location_id"]
KEY = ["location_id", "ts"]


@register("badge_tiers", oracle([OBS_WIDE_SQL], """
SELECT location_id, count(*) AS total_records, avg(aqi) AS avg_value, max(aqi) AS max_value, min(aqi) AS min_value,
  CASE WHEN count(*) >= 100 THEN 'Data Collector' WHEN count(*) >= 50 THEN 'Data Enthusiast' ELSE 'Beginner' END AS records_badge,
  CASE WHEN avg(aqi) <= 30 THEN 'Clean Air Champion' WHEN avg(aqi) <= 60 THEN 'Air Quality Aware' ELSE 'Air Quality Monitor' END AS average_badge,
  CASE WHEN max(aqi) <= 50 THEN 'Safety Guardian' WHEN max(aqi) <= 100 THEN 'Air Quality Watcher' ELSE 'Air Quality Alert' END AS maximum_badge,
  CASE WHEN min(aqi) <= 20 THEN 'Perfect Air Seeker' WHEN min(aqi) <= 40 THEN 'Clean Air Explorer' ELSE 'Air Quality Learner' END AS minimum_badge
FROM obs_wide GROUP BY location_id""", ["avg_value", "max_value", "min_value"]))
def q_badge_tiers(spark, sf):
    return I.badge_tiers(obs_wide(spark, sf), K, "aqi")


@register("format_display", oracle([OBS_WIDE_SQL], f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M') AS "Date",
  CASE WHEN aqi IS NOT NULL THEN printf('%.1f', aqi) END AS "AQI",
  {CAT_SQL.format(c='aqi')} AS "Category", location_id AS "Location"
FROM obs_wide""", []))
def q_format_display(spark, sf):
    d = obs_wide(spark, sf).withColumn("category", C.aqi_category("aqi"))
    return I.format_display(d, {"ts": ("Date", "datetime"), "aqi": ("AQI", "1f"), "category": ("Category", "text"),
                                "location_id": ("Location", "text")})


@register("history_overview", oracle([OBS_WIDE_SQL], """
SELECT location_id, count(*) AS total_records, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date,
  avg(aqi) AS avg_aqi FROM obs_wide GROUP BY location_id""", ["avg_aqi"]))
def q_history_overview(spark, sf):
    return I.history_overview(obs_wide(spark, sf), K, "ts", "aqi")


@register("hourly_profile", oracle([OBS_WIDE_SQL], """
SELECT location_id, CAST(hour(ts) AS INTEGER) AS hour, avg(aqi) AS avg_aqi FROM obs_wide GROUP BY 1, 2""",
    ["avg_aqi"]))
def q_hourly_profile(spark, sf):
    return I.hourly_profile(obs_wide(spark, sf), K, "ts", "aqi")


@register("best_worst_hour", oracle([OBS_WIDE_SQL, """prof AS (
  SELECT location_id, CAST(hour(ts) AS INTEGER) AS hour, avg(aqi) AS avg_aqi FROM obs_wide GROUP BY 1, 2
  HAVING avg(aqi) IS NOT NULL)"""], """
SELECT location_id, arg_max(hour, (avg_aqi, -hour)) AS worst_hour, max(avg_aqi) AS worst_avg_aqi,
  arg_min(hour, (avg_aqi, hour)) AS best_hour, min(avg_aqi) AS best_avg_aqi
FROM prof GROUP BY location_id""", ["worst_avg_aqi", "best_avg_aqi"]))
def q_best_worst_hour(spark, sf):
    return I.best_worst_hour(obs_wide(spark, sf), K, "ts", "aqi")


def _corr_sql(x, y):
    xx = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    yy = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    return f"covar_samp({xx}, {yy}) / nullif(stddev_samp({xx}) * stddev_samp({yy}), 0)"


def _rel_sql(c):
    return f"CASE WHEN abs({c}) > 0.3 THEN CASE WHEN {c} > 0 THEN 'positive' ELSE 'negative' END ELSE 'weak' END"


@register("weather_correlation", oracle([OBS_DENSE_SQL], f"""
SELECT location_id, temperature_corr, {_rel_sql('temperature_corr')} AS temperature_relation,
  humidity_corr, {_rel_sql('humidity_corr')} AS humidity_relation
FROM (SELECT location_id, {_corr_sql('temperature', 'aqi')} AS temperature_corr,
        {_corr_sql('humidity', 'aqi')} AS humidity_corr FROM obs_dense GROUP BY location_id)""",
    ["temperature_corr", "humidity_corr"]))
def q_weather_correlation(spark, sf):
    return I.weather_correlation(obs_dense(spark, sf), ["temperature", "humidity"], "aqi", K)


@register("column_means", oracle([OBS_WIDE_SQL], "SELECT location_id, " + ", ".join(
    f"avg({c}) AS {c}" for c in SERIES) + " FROM obs_wide GROUP BY location_id", SERIES))
def q_column_means(spark, sf):
    return I.column_means(obs_wide(spark, sf), SERIES, K)


def _advice_sql(c):
    icon = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.CATEGORY_ADVICE.items())
    msg = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.CATEGORY_ADVICE.items())
    act = " ".join(f"WHEN '{k}' THEN '{'; '.join(v[2])}'" for k, v in C.CATEGORY_ADVICE.items())
    g = C.CATEGORY_ADVICE["Good"]
    return (f"CASE {c} {icon} ELSE '{g[0]}' END AS icon, CASE {c} {msg} ELSE '{g[1]}' END AS message, "
            f"CASE {c} {act} ELSE '{'; '.join(g[2])}' END AS actions")


@register("max_forecast_category", oracle([OBS_WIDE_SQL], f"""
SELECT location_id, max_aqi, category, {_advice_sql('category')}
FROM (SELECT location_id, max_aqi, {CAT_SQL.format(c='max_aqi')} AS category
      FROM (SELECT location_id, max(aqi) AS max_aqi FROM obs_wide GROUP BY location_id))""", ["max_aqi"]))
def q_max_forecast_category(spark, sf):
    return I.max_forecast_category(obs_wide(spark, sf), K, "aqi").withColumn("actions", F.array_join("actions", "; "))


@register("latest_reading", oracle([OBS_WIDE_SQL], """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts DESC) AS rn FROM obs_wide) WHERE rn = 1""",
    SERIES))
def q_latest_reading(spark, sf):
    return I.latest_reading(obs_wide(spark, sf), K, "ts")


@register("sort_by_time", oracle([OBS_LONG_SQL], """
SELECT location_id, event_id, ts, value FROM obs_long ORDER BY ts DESC, event_id""", ["value"]))
def q_sort_by_time(spark, sf):
    return I.sort_by_time(obs_long(spark, sf).select("location_id", "event_id", "ts", "value"), "ts", asc=False)


@register("top_features", oracle([OBS_LONG_SQL], """
SELECT feature, importance FROM (
  SELECT 'location_' || CAST(location_id AS VARCHAR) AS feature, sum(value) AS importance
  FROM obs_long GROUP BY location_id) ORDER BY importance DESC, feature LIMIT 10""", ["importance"]))
def q_top_features(spark, sf):
    imp = obs_long(spark, sf).groupBy("location_id").agg(F.sum("value").alias("importance")).select(
        F.concat(F.lit("location_"), F.col("location_id").cast("string")).alias("feature"), "importance")
    return I.top_features(imp, 10)


@register("first_cap", oracle([OBS_WIDE_SQL], """
SELECT location_id, ts, aqi FROM obs_wide ORDER BY ts, location_id LIMIT 100""", ["aqi"]))
def q_first_cap(spark, sf):
    return I.first_cap(obs_wide(spark, sf).select(*KEY, "aqi"), "ts", 100, tie=["location_id"])


_EVAL_SRC = """ev AS (SELECT location_id, aqi AS label,
  lag(aqi, 1) OVER (PARTITION BY location_id ORDER BY ts) AS prediction FROM obs_wide)"""
_EVAL_BODY = """SELECT location_id, count(y - p) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  avg(abs((y - p) / CASE WHEN y <> 0 THEN y END)) * 100.0::DOUBLE AS mape,
  1.0::DOUBLE - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2
FROM (SELECT location_id, CASE WHEN label IS NOT NULL AND prediction IS NOT NULL THEN label END AS y,
        CASE WHEN label IS NOT NULL AND prediction IS NOT NULL THEN prediction END AS p FROM ev)
GROUP BY location_id"""


def _eval_frame(spark, sf):
    from pyspark.sql import Window
    d = obs_wide(spark, sf)
    return d.select("location_id", F.col("aqi").alias("label"),
                    F.lag("aqi", 1).over(Window.partitionBy("location_id").orderBy("ts")).alias("prediction"))


@register("evaluate", oracle([OBS_WIDE_SQL, _EVAL_SRC], _EVAL_BODY, ["rmse", "mae", "mape", "r2"]))
def q_evaluate(spark, sf):
    return I.evaluate(_eval_frame(spark, sf), "label", "prediction", K)


@register("select_best", oracle([OBS_WIDE_SQL, _EVAL_SRC, f"res AS ({_EVAL_BODY})"], """
SELECT * FROM res ORDER BY rmse ASC NULLS LAST, location_id LIMIT 1""", ["rmse", "mae", "mape", "r2"]))
def q_select_best(spark, sf):
    return I.select_best(I.evaluate(_eval_frame(spark, sf), "label", "prediction", K), "rmse", "location_id")
