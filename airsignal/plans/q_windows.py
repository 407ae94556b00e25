"""Queries for the per-location window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from airsignal.operators import windows as W
from airsignal.plans.frames import OBS_LONG_SQL, OBS_WIDE_SQL, SERIES, obs_long, obs_wide
from airsignal.plans.registry import oracle, register

K = ["location_id"]
KEY = ["location_id", "ts"]
WSQL = "PARTITION BY location_id ORDER BY ts"
SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

_LAGS = [f"{c}_lag_{k}" for c in SERIES for k in (1, 2, 3)]


@register("lag_features", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"lag({c}, {k}) OVER ({WSQL}) AS {c}_lag_{k}" for c in SERIES for k in (1, 2, 3)) + " FROM obs_wide", _LAGS))
def q_lag_features(spark, sf):
    return W.lag_features(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, (1, 2, 3), K, "ts").select(*KEY, *_LAGS)


_CHG = [f"{c}_change_rate" for c in SERIES]


@register("change_rate", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"{c} - lag({c}, 1) OVER ({WSQL}) AS {c}_change_rate" for c in SERIES) + " FROM obs_wide", _CHG))
def q_change_rate(spark, sf):
    return W.change_rate(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, K, "ts").select(*KEY, *_CHG)


_PCT = [f"{c}_change_rate_pct" for c in SERIES]


@register("change_rate_pct", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"f_{c} / nullif(lag(f_{c}, 1) OVER ({WSQL}), 0) - 1 AS {c}_change_rate_pct" for c in SERIES)
    + " FROM (SELECT location_id, ts, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_{c}"
    for c in SERIES) + " FROM obs_wide)", _PCT))
def q_change_rate_pct(spark, sf):
    return W.change_rate_pct(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, K, "ts").select(*KEY, *_PCT)


def _roll_sql(rows: int, stats, sfx: str) -> tuple[str, list[str]]:
    names, exprs = [], []
    for c in SERIES:
        for s in stats:
            n = f"{c}_rolling_{s}_{sfx}"
            names.append(n)
            exprs.append(f"{SQL_STAT[s]}({c}) OVER ({WSQL} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW) AS {n}")
    return "SELECT location_id, ts, " + ", ".join(exprs) + " FROM obs_wide", names


_R24_SQL, _R24 = _roll_sql(24, ("mean", "std", "min", "max"), "24h")
_R168_SQL, _R168 = _roll_sql(168, ("mean", "std"), "7d")


@register("rolling_24", oracle([OBS_WIDE_SQL], _R24_SQL, _R24))
def q_rolling_24(spark, sf):
    return W.rolling(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, 24, ("mean", "std", "min", "max"),
                     K, "ts").select(*KEY, *_R24)


@register("rolling_168", oracle([OBS_WIDE_SQL], _R168_SQL, _R168))
def q_rolling_168(spark, sf):
    return W.rolling(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, 168, ("mean", "std"),
                     K, "ts").select(*KEY, *_R168)


_RT_COLS = ["aqi", "pm25"]
_RT = [f"{c}_rolling_{s}_24h_time" for c in _RT_COLS for s in ("mean", "std", "min", "max")]


@register("rolling_time", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"{SQL_STAT[s]}({c}) OVER (PARTITION BY location_id ORDER BY epoch_us(ts) "
    f"RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS {c}_rolling_{s}_24h_time"
    for c in _RT_COLS for s in ("mean", "std", "min", "max")) + " FROM obs_wide", _RT))
def q_rolling_time(spark, sf):
    return W.rolling_time(obs_wide(spark, sf).select(*KEY, *_RT_COLS), _RT_COLS, 24, keys=K, ts="ts") \
        .select(*KEY, *_RT)


@register("ffill", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
    for c in SERIES) + " FROM obs_wide", SERIES))
def q_ffill(spark, sf):
    return W.ffill(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, K, "ts")


@register("fill_missing", oracle([OBS_WIDE_SQL], "SELECT location_id, ts, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in SERIES) + " FROM obs_wide", SERIES))
def q_fill_missing(spark, sf):
    return W.fill_missing(obs_wide(spark, sf).select(*KEY, *SERIES), SERIES, K, "ts")


@register("fill_mode", oracle([OBS_LONG_SQL, """tagged AS (
  SELECT location_id, event_id, CASE WHEN value > 300 THEN NULL ELSE measure END AS tag FROM obs_long)""",
                               """modes AS (
  SELECT location_id, tag AS mode_tag FROM (
    SELECT location_id, tag, row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, tag) AS rn
    FROM tagged WHERE tag IS NOT NULL GROUP BY location_id, tag) WHERE rn = 1)"""], """
SELECT t.location_id, t.event_id, coalesce(t.tag, m.mode_tag, 'Unknown') AS tag
FROM tagged t LEFT JOIN modes m ON t.location_id = m.location_id""", []))
def q_fill_mode(spark, sf):
    d = obs_long(spark, sf).select("location_id", "event_id",
                                   F.when(F.col("value") <= 300, F.col("measure")).alias("tag"))
    return W.fill_mode(d, ["tag"], K)


@register("head_tail_trend", oracle([OBS_WIDE_SQL], """
SELECT location_id, n_records, recent_mean, older_mean, recent_mean - older_mean AS trend,
  CASE WHEN recent_mean - older_mean < -5 THEN 'improving' WHEN recent_mean - older_mean > 5 THEN 'worsening'
       ELSE 'stable' END AS trend_label
FROM (SELECT location_id, count(*) AS n_records, avg(aqi) FILTER (WHERE pos > cnt - 10) AS recent_mean,
        avg(aqi) FILTER (WHERE pos <= 10) AS older_mean
      FROM (SELECT location_id, aqi, row_number() OVER (PARTITION BY location_id ORDER BY ts) AS pos,
              count(*) OVER (PARTITION BY location_id) AS cnt FROM obs_wide)
      GROUP BY location_id HAVING count(*) >= 2)""", ["recent_mean", "older_mean", "trend"]))
def q_head_tail_trend(spark, sf):
    return W.head_tail_trend(obs_wide(spark, sf), "aqi", K, "ts")


# --- the blocked plan: same results, with NULL locations and a NULL time -------------------------

# every 7th location is NULL (one series of all their rows), and the last hour of each series has no time
_HOLES_SQL = """holes AS (SELECT CASE WHEN location_id % 7 = 0 THEN NULL ELSE location_id END AS location_id,
  CASE WHEN ts = max(ts) OVER (PARTITION BY location_id) AND location_id % 7 <> 0 THEN NULL ELSE ts END AS ts,
  location_id AS tie, """ + ", ".join(SERIES) + " FROM obs_wide)"
_HSQL = "PARTITION BY location_id ORDER BY ts NULLS FIRST, tie"
_BLOCK = {"tie": ["tie"], "strategy": "blocked", "block_rows": 61}


def _holes(spark, sf):
    from pyspark.sql import Window

    d = obs_wide(spark, sf)
    last = F.max("ts").over(Window.partitionBy("location_id"))
    hole = F.col("location_id") % 7 == 0
    return d.select(F.when(~hole, F.col("location_id")).alias("location_id"),
                    F.when((F.col("ts") == last) & ~hole, F.lit(None)).otherwise(F.col("ts")).alias("ts"),
                    F.col("location_id").alias("tie"), *SERIES)


def _on_holes(sql: str) -> str:
    return sql.replace(WSQL, _HSQL).replace("FROM obs_wide", "FROM holes").replace("SELECT location_id, ts,", "SELECT location_id, ts, tie,")


def _blocked(name, sql, cols, run):
    @register(f"{name}_blocked", oracle([OBS_WIDE_SQL, _HOLES_SQL], _on_holes(sql), cols))
    def q(spark, sf):
        return run(_holes(spark, sf)).select(*KEY, "tie", *cols)


_FF_SQL = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in SERIES)
_FM_SQL = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER ({WSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}" for c in SERIES)

_blocked("lag_features", "SELECT location_id, ts, " + ", ".join(f"lag({c}, {k}) OVER ({WSQL}) AS {c}_lag_{k}" for c in SERIES for k in (1, 2, 3))
         + " FROM obs_wide", _LAGS, lambda d: W.lag_features(d, SERIES, (1, 2, 3), K, "ts", **_BLOCK))
_blocked("change_rate", "SELECT location_id, ts, " + ", ".join(f"{c} - lag({c}, 1) OVER ({WSQL}) AS {c}_change_rate" for c in SERIES)
         + " FROM obs_wide", _CHG, lambda d: W.change_rate(d, SERIES, K, "ts", **_BLOCK))
_blocked("change_rate_pct", "SELECT location_id, ts, " + ", ".join(
    f"f_{c} / nullif(lag(f_{c}, 1) OVER ({WSQL}), 0) - 1 AS {c}_change_rate_pct" for c in SERIES)
    + " FROM (SELECT location_id, ts, " + _FF_SQL.replace(" AS ", " AS f_") + " FROM obs_wide)", _PCT,
    lambda d: W.change_rate_pct(d, SERIES, K, "ts", **_BLOCK))
_blocked("rolling_24", _R24_SQL, _R24, lambda d: W.rolling(d, SERIES, 24, ("mean", "std", "min", "max"), K, "ts", **_BLOCK))
_blocked("rolling_168", _R168_SQL, _R168, lambda d: W.rolling(d, SERIES, 168, ("mean", "std"), K, "ts", **_BLOCK))
_blocked("ffill", "SELECT location_id, ts, " + _FF_SQL + " FROM obs_wide", SERIES, lambda d: W.ffill(d, SERIES, K, "ts", **_BLOCK))
_blocked("fill_missing", "SELECT location_id, ts, " + _FM_SQL + " FROM obs_wide", SERIES,
         lambda d: W.fill_missing(d, SERIES, K, "ts", **_BLOCK))
_blocked("rolling_time", "SELECT location_id, ts, " + ", ".join(
    f"{SQL_STAT[s]}({c}) OVER (PARTITION BY location_id ORDER BY epoch_us(ts) NULLS FIRST "
    f"RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS {c}_rolling_{s}_24h_time"
    for c in _RT_COLS for s in ("mean", "std", "min", "max")) + " FROM obs_wide", _RT,
    lambda d: W.rolling_time(d, _RT_COLS, 24, keys=K, ts="ts", strategy="blocked"))


@register("head_tail_trend_blocked", oracle([OBS_WIDE_SQL, _HOLES_SQL], """
SELECT location_id, n_records, recent_mean, older_mean, recent_mean - older_mean AS trend,
  CASE WHEN recent_mean - older_mean < -5 THEN 'improving' WHEN recent_mean - older_mean > 5 THEN 'worsening'
       ELSE 'stable' END AS trend_label
FROM (SELECT location_id, count(*) AS n_records, avg(aqi) FILTER (WHERE pos > cnt - 10) AS recent_mean,
        avg(aqi) FILTER (WHERE pos <= 10) AS older_mean
      FROM (SELECT location_id, aqi, row_number() OVER ({w}) AS pos,
              count(*) OVER (PARTITION BY location_id) AS cnt FROM holes)
      GROUP BY location_id HAVING count(*) >= 2)""".replace("{w}", _HSQL), ["recent_mean", "older_mean", "trend"]))
def q_head_tail_trend_blocked(spark, sf):
    return W.head_tail_trend(_holes(spark, sf), "aqi", K, "ts", **_BLOCK)
