"""Feature blocks and the full feature table.

Each block is one ``withColumns`` (one Project node), so a 100+ column feature
table is a handful of plan nodes. ``derived_features`` reads every series once, in order, and makes all lags,
changes and rolling statistics in linear time (:mod:`airsignal.operators.sliding`: one
Exchange on the location keys, one sort, Arrow batches; or blocks with halos for hot keys). ``all_features`` fills in
the same walk. Series columns of other types than double and float go by window expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsignal.functions import columns as C
from airsignal.operators import sliding as SL
from airsignal.operators import windows as W
from airsignal.operators.series import SeriesPlan, plan_series

# Fixed feature vocabulary of the reference pipeline.
LAG_SERIES = ["aqi", "temperature", "humidity", "wind_speed", "pm25", "pm10"]
POLLUTANTS = ["pm25", "pm10", "o3", "no2", "so2", "co"]
EXCLUDE = ["timestamp", "location", "weather", "air_pollution_openweather", "air_quality_aqicn", "source",
           "aqi_openweather", "aqi_aqicn"]
TIME_COLS = ["hour", "day", "month", "day_of_week", "is_weekend", "season",
             "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]


def time_features(df: DataFrame, ts: str = "ts", tz: str | Column | None = None) -> DataFrame:
    """hour, day, month, day_of_week, is_weekend, season and six sin/cos columns."""
    t = C._local(ts, tz)
    hour, day, month = F.hour(t).cast("int"), F.dayofmonth(t).cast("int"), F.month(t).cast("int")
    two_pi = F.lit(2 * 3.141592653589793)
    return df.withColumns({
        "hour": hour, "day": day, "month": month,
        "day_of_week": C.day_of_week(t), "is_weekend": C.is_weekend(t), "season": C.season(t),
        "hour_sin": F.sin(two_pi * hour / F.lit(24.0)), "hour_cos": F.cos(two_pi * hour / F.lit(24.0)),
        "day_sin": F.sin(two_pi * day / F.lit(31.0)), "day_cos": F.cos(two_pi * day / F.lit(31.0)),
        "month_sin": F.sin(two_pi * month / F.lit(12.0)), "month_cos": F.cos(two_pi * month / F.lit(12.0)),
    })


def weather_features(df: DataFrame) -> DataFrame:
    """Squares/cubes, centred pressure, wind direction components, scaled visibility/clouds."""
    have = set(df.columns)
    df = C.numeric_coerce(df, [c for c in ["temperature", "humidity", "pressure", "wind_speed", "wind_direction",
                                           "visibility", "clouds"] if c in have])
    t = lambda c: F.col(c)
    out: dict[str, Column] = {}
    if "temperature" in have:
        out["temperature_squared"] = t("temperature") * t("temperature")
        out["temperature_cubed"] = t("temperature") * t("temperature") * t("temperature")
    if "humidity" in have:
        out["humidity_squared"] = t("humidity") * t("humidity")
    if "pressure" in have:
        out["pressure_normalized"] = (t("pressure") - F.lit(C.PRESSURE_REF)) / F.lit(C.PRESSURE_REF)
    if "wind_speed" in have:
        out["wind_speed_squared"] = t("wind_speed") * t("wind_speed")
    if "wind_direction" in have:
        r = F.radians(t("wind_direction"))
        out["wind_direction_sin"], out["wind_direction_cos"] = F.sin(r), F.cos(r)
    if "visibility" in have:
        out["visibility_normalized"] = t("visibility") / F.lit(C.VISIBILITY_SCALE)
    if "clouds" in have:
        out["clouds_normalized"] = t("clouds") / F.lit(C.CLOUDS_SCALE)
    return df.withColumns(out) if out else df


def pollutant_features(df: DataFrame) -> DataFrame:
    """Per pollutant square and log1p; across-pollutant sum/mean/std/max when >= 2 are present."""
    avail = [c for c in POLLUTANTS if c in df.columns]
    df = C.numeric_coerce(df, avail)
    out: dict[str, Column] = {}
    for c in avail:
        out[f"{c}_squared"] = F.col(c) * F.col(c)
        out[f"{c}_log"] = F.when(F.col(c) > -1, F.log1p(F.col(c)))
    df = df.withColumns(out) if out else df
    return C.row_stats(df, avail, "pollutant") if len(avail) >= 2 else df


def interaction_exprs(have: set[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if {"temperature", "humidity"} <= have:
        out["temp_humidity_interaction"] = F.col("temperature") * F.col("humidity")
    if {"pm25", "pm10"} <= have:
        out["pm25_pm10_ratio"] = F.try_divide(F.col("pm25"), F.col("pm10") + F.lit(1e-8))
    if {"wind_speed", "pm25"} <= have:
        out["wind_pm25_interaction"] = F.col("wind_speed") * F.col("pm25")
    return out


def derived_exprs(plan: SeriesPlan, series: Sequence[str], have: set[str]) -> list[dict[str, Column]]:
    """Column groups (in dependency order) of lags, changes, rolling stats and interactions, as window expressions."""
    filled = {c: f"__ff_{c}" for c in series}
    first = {filled[c]: e for c, e in plan.ffill(series).items()}
    plan.helpers += list(filled.values())
    second: dict[str, Column] = {}
    second.update(W.lag_exprs(plan, series, (1, 2, 3)))
    second.update(W.change_exprs(plan, series))
    second.update(W.pct_from_filled(plan, filled))
    second.update(W.rolling_exprs(plan, series, 24, ("mean", "std", "min", "max")))
    second.update(W.rolling_exprs(plan, series, 168, ("mean", "std")))
    second.update(interaction_exprs(have))
    return [first, second]


def derived_features(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] | None = None,
                     include_target: bool = True, target: str = "aqi", strategy: str | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Lags 1-3, change, pct change, rolling 24/168-row stats and interactions, one walk over every series."""
    have, order = set(df.columns), [ts, *(tie or [])]
    series = [c for c in LAG_SERIES if c in have and (include_target or c != target)]
    if not W.floating(df, series):
        plan = plan_series(df, keys, order, SL.DERIVED.look_back, strategy, block_rows)
        for group in derived_exprs(plan, series, have):
            plan.with_columns(group)
        return plan.finish()
    walk = SL.Pass(list(keys), series, SL.DERIVED)
    return W.walked_series(df, walk, order, SL.DERIVED.names(series), strategy, block_rows).withColumns(interaction_exprs(have))


def select_features(df: DataFrame, target: str = "aqi", keep: Sequence[str] = ("location_id", "ts")) -> DataFrame:
    """Drop the non-feature columns; keys first, features, target last."""
    keep = [k for k in keep if k in df.columns]
    feats = [c for c in df.columns if c not in EXCLUDE and c != target and c not in keep]
    return df.select(*keep, *feats, target)


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` in that order; missing ones are 0.0, extras are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])


def resolve_target(df: DataFrame, target: str = "aqi",
                   fallbacks: Sequence[str] = ("aqi_openweather", "aqi_aqicn")) -> DataFrame:
    """The first existing of ``target``, ``fallbacks`` becomes ``target`` (chosen at plan time)."""
    for c in (target, *fallbacks):
        if c in df.columns:
            return df if c == target else df.withColumn(target, F.col(c))
    raise ValueError(f"no target column: none of {[target, *fallbacks]} exists")


def time_range_filter(df: DataFrame, ts: str = "ts", hours: float = 24, as_of=None) -> DataFrame:
    """Rows with ts >= as_of - hours. ``as_of`` None = the latest ts, as a scalar subquery (lazy)."""
    if as_of is None:
        bound = df.select(F.max(ts)).scalar()
    else:
        bound = F.lit(as_of)
    return df.filter(F.col(ts) >= bound - F.expr(f"INTERVAL '{int(round(hours * 3600))}' SECOND"))


def fill_numeric(df: DataFrame, keys: Sequence[str], ts: str, skip: Sequence[str] = (), causal: bool = False,
                 strategy: str | None = None, block_rows: int | None = None) -> DataFrame:
    """``fill_missing`` on every numeric column that can be NULL."""
    num = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")
           and n not in keys and n != ts and n not in skip]
    return W.fill_missing(df, num, keys, ts, causal=causal, strategy=strategy, block_rows=block_rows)


def base_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Flattened readings with their weather, pollutant and interaction features (what needs one row only); and the names of the readings' columns."""
    from airsignal.sources.parse import flatten_nested

    if "weather" in df.columns and dict(df.dtypes)["weather"].startswith("struct"):
        df = flatten_nested(df)
    d = pollutant_features(weather_features(df))
    return d.withColumns(interaction_exprs(set(df.columns))), df.columns


def feature_walk(d: DataFrame, keys: Sequence[str], ts: str, target: str = "aqi", include_target: bool = False) -> SL.Pass | None:
    """The walk that derives and fills every numeric column of ``base_features``; None where a column is not floating."""
    series = [c for c in LAG_SERIES if c in d.columns and (include_target or c != target)]
    num = [n for n, t in d.dtypes if t in NUMBERS and n not in (*keys, ts, *TIME_COLS)]
    if not W.floating(d, [*series, *num]):
        return None
    return SL.Pass(list(keys), series, SL.DERIVED, fill=[*num, *SL.DERIVED.names(series)])


NUMBERS = ("double", "float", "int", "bigint", "smallint")


def finished(d: DataFrame, readings: Sequence[str], keys: Sequence[str], ts: str, target: str, tz) -> DataFrame:
    """Walked rows -> time features, text by the table's mode, target; readings, time, row features, derived, interactions in this order."""
    rows = list(interaction_exprs(set(readings)))
    rest = [c for c in d.columns if c not in (*readings, *rows, *TIME_COLS)]
    d = time_features(d, ts, tz)
    text = [n for n, t in d.dtypes if t == "string" and n not in (*keys, ts, *EXCLUDE)]
    d = W.fill_mode(d, text) if text else d
    d = d.select(*[c for c in readings if c not in TIME_COLS], *TIME_COLS, *rest, *rows)
    return select_features(resolve_target(d, target), target, keep=[*keys, ts])


def all_features(df: DataFrame, keys: Sequence[str] = ("location_id",), ts: str = "ts", target: str = "aqi",
                 include_target_change: bool = False, causal: bool = False, tz: str | None = None,
                 strategy: str | None = None, block_rows: int | None = None) -> DataFrame:
    """flatten -> time -> weather -> pollutant -> derived -> fill (text by the table's mode) -> target -> select.

    One walk over the series derives and fills. The backward fill needs the first value of each series, which a first,
    narrow walk finds (the same deal and sort; one row per series comes back); ``causal=True`` does without it.
    """
    keys = list(keys)
    d, readings = base_features(df)
    walk = feature_walk(d, keys, ts, target, include_target_change)
    if walk is None:
        return _all_features_windows(df, keys, ts, target, include_target_change, causal, tz, strategy, block_rows)
    out = W.walked_series(d, walk, [ts], SL.DERIVED.names(walk.series), strategy, block_rows, backward=not causal)
    return finished(out, readings, keys, ts, target, tz)


def _all_features_windows(df: DataFrame, keys: Sequence[str], ts: str, target: str, include_target_change: bool, causal: bool, tz,
                          strategy: str | None, block_rows: int | None) -> DataFrame:
    """The same by window expressions, for columns that are not floating."""
    from airsignal.session import check_codegen_cache
    from airsignal.sources.parse import flatten_nested

    check_codegen_cache(df.sparkSession)
    if "weather" in df.columns and dict(df.dtypes)["weather"].startswith("struct"):
        df = flatten_nested(df)
    d = pollutant_features(weather_features(time_features(df, ts, tz)))
    d = derived_features(d, keys, ts, include_target=include_target_change, target=target, strategy=strategy, block_rows=block_rows)
    d = fill_numeric(d, keys, ts, skip=TIME_COLS, causal=causal, strategy=strategy, block_rows=block_rows)
    text = [n for n, t in d.dtypes if t == "string" and n not in (*keys, ts, *EXCLUDE)]
    d = W.fill_mode(d, text) if text else d
    return select_features(resolve_target(d, target), target, keep=[*keys, ts])
