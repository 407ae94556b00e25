"""Feed parsing, merging and flattening.

Documents arrive as JSON text; ``from_json`` with an explicit schema parses them
in the JVM (no Python worker), missing fields become NULL and are defaulted
with ``coalesce``. Epoch seconds become TIMESTAMP_NTZ wall-clock values (UTC).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsignal.functions.columns import aqi_index_to_scale
from airsignal.sources import schemas as S


def epoch_to_ts(c: Column) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ (UTC wall clock)."""
    return F.timestamp_micros(c.cast("long") * F.lit(1_000_000)).cast("timestamp_ntz")


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _split(env: DataFrame, keep: Sequence[str], json_col: str, ok: Column, reason: Column,
           cols: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows whose document has what is required, the others with their raw text and the reason)."""
    ok = F.coalesce(ok, F.lit(False))
    return (env.filter(ok).select(*keep, *cols),
            env.filter(~ok).select(*keep, F.col(json_col).alias("raw"), reason.alias("reason")))


UNPARSABLE = "unparsable document"


def _once(parsed: Column, name: str) -> Column:
    """The parsed document as a column that is computed once per row.

    A one-element explode: without it the optimizer copies the parsing into the filter and into every field that is read.
    """
    return F.explode(F.array(parsed)).alias(name)


def parse_weather(df: DataFrame, json_col: str = "json", keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Weather document -> (good, rejected); missing wind.deg and visibility -> 0.

    A document without one of the objects main, wind, clouds, sys or a first weather entry is rejected.
    """
    keep = [c for c in df.columns if c != json_col] if keep is None else list(keep)
    env = df.select(*keep, F.col(json_col), _once(F.from_json(F.col(json_col), S.WEATHER_DOC), "__w"))
    first = F.get(F.col("__w.weather"), 0)
    ok = first.isNotNull()
    for part in ("main", "wind", "clouds", "sys"):
        ok = ok & F.col(f"__w.{part}").isNotNull()
    return _split(env, keep, json_col, ok, F.lit(UNPARSABLE), [
        F.col("__w.main.temp").alias("temperature"),
        F.col("__w.main.feels_like").alias("feels_like"),
        F.col("__w.main.humidity").alias("humidity"),
        F.col("__w.main.pressure").alias("pressure"),
        F.col("__w.wind.speed").alias("wind_speed"),
        _zero(F.col("__w.wind.deg")).alias("wind_direction"),
        first.getField("description").alias("description"),
        first.getField("icon").alias("icon"),
        _zero(F.col("__w.visibility")).alias("visibility"),
        F.col("__w.clouds.all").alias("clouds"),
        epoch_to_ts(F.col("__w.sys.sunrise")).alias("sunrise"),
        epoch_to_ts(F.col("__w.sys.sunset")).alias("sunset"),
    ])


def parse_pollution(df: DataFrame, json_col: str = "json", keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pollution document -> (good, rejected): first list entry; index -> AQI scale; missing component -> 0.

    A document whose list has no first entry with main and components is rejected.
    """
    keep = [c for c in df.columns if c != json_col] if keep is None else list(keep)
    first = F.get(F.from_json(F.col(json_col), S.POLLUTION_DOC).getField("list"), 0)
    env = df.select(*keep, F.col(json_col), _once(first, "__p"))
    ok = F.col("__p.main").isNotNull() & F.col("__p.components").isNotNull()
    comp = lambda n: _zero(F.col(f"__p.components.{n}"))
    return _split(env, keep, json_col, ok, F.lit(UNPARSABLE), [
        epoch_to_ts(F.col("__p.dt")).alias("pollution_ts"),
        aqi_index_to_scale(F.col("__p.main.aqi")).alias("aqi"),
        comp("pm2_5").alias("pm25"), comp("pm10").alias("pm10"), comp("o3").alias("o3"),
        comp("no2").alias("no2"), comp("so2").alias("so2"), comp("co").alias("co"), comp("nh3").alias("nh3"),
    ])


def parse_second_source(df: DataFrame, json_col: str = "json",
                        keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Second feed -> (good, rejected). ``iaqi.<x>.v`` missing -> 0; a document without ``status`` is fine.

    Rejected: ``status = 'error'`` (then ``data`` is an error text) or no ``data`` object with ``iaqi``;
    they keep the raw text and a ``reason``.
    """
    keep = [c for c in df.columns if c != json_col] if keep is None else list(keep)
    env = df.select(*keep, F.col(json_col), _once(F.from_json(F.col(json_col), S.SECOND_ENVELOPE), "__e"))
    env = env.select("*", _once(F.from_json(F.col("__e.data"), S.SECOND_DATA), "__d"))
    failed = F.coalesce(F.col("__e.status") == "error", F.lit(False))
    iaqi = lambda n: _zero(F.try_element_at(F.col("__d.iaqi"), F.lit(n)).getField("v"))
    reason = F.when(failed, F.concat(F.lit("source error: "), F.coalesce(F.col("__e.data"), F.lit("Unknown error")))) \
        .otherwise(F.lit(UNPARSABLE))
    return _split(env, keep, json_col, ~failed & F.col("__d.iaqi").isNotNull(), reason,
                  [F.col("__d.aqi").alias("aqi"), *[iaqi(n).alias(n) for n in S.SECOND_MEASURES]])


def explode_forecast(df: DataFrame, json_col: str = "json", keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Forecast document -> (one row per list entry, rejected documents).

    ``step`` is the position; pop and wind.deg default 0. A document without a list is rejected; an empty list has no rows.
    """
    keep = [c for c in df.columns if c != json_col] if keep is None else list(keep)
    env = df.select(*keep, F.col(json_col), _once(F.from_json(F.col(json_col), S.FORECAST_DOC).getField("list"), "__l"))
    whole, rejected = _split(env, keep, json_col, F.col("__l").isNotNull(), F.lit(UNPARSABLE), [F.col("__l")])
    ex = whole.select(*keep, F.posexplode("__l").alias("step", "__f"))
    first = F.get(F.col("__f.weather"), 0)
    return ex.select(
        *keep, F.col("step").cast("int").alias("step"),
        epoch_to_ts(F.col("__f.dt")).alias("ts"),
        F.col("__f.main.temp").alias("temperature"), F.col("__f.main.humidity").alias("humidity"),
        F.col("__f.main.pressure").alias("pressure"), F.col("__f.wind.speed").alias("wind_speed"),
        _zero(F.col("__f.wind.deg")).alias("wind_direction"),
        first.getField("description").alias("description"), first.getField("icon").alias("icon"),
        F.col("__f.clouds.all").alias("clouds"), _zero(F.col("__f.pop")).alias("pop"),
    ), rejected


POLLUTION_FIELDS = ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]
WEATHER_FIELDS = ["temperature", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
                  "description", "icon", "visibility", "clouds", "sunrise", "sunset"]


def merge_sources(weather: DataFrame, pollution: DataFrame, second: DataFrame | None, keys: Sequence[str],
                  ts: str = "ts", source: str = "data_collector") -> DataFrame:
    """One nested reading per key: weather ⋈ pollution (inner) ⟕ second source.

    Where the second feed has no row, or is absent as a whole (``None``), its struct is built
    from the pollution feed's seven values and timestamp (as the reference's fallback does).
    Equi-joins on the keys; skewed keys are split by AQE's skew-join handling.
    """
    keys = list(keys)
    w = weather.select(*keys, *([ts] if ts in weather.columns else []),
                       F.struct(*[c for c in WEATHER_FIELDS if c in weather.columns]).alias("weather"))
    p = pollution.select(*keys, F.struct(F.col("pollution_ts").alias("ts"), *POLLUTION_FIELDS, "nh3")
                         .alias("pollution"))
    out = w.join(p, keys, "inner")
    fallback = F.struct(F.col("pollution.ts").alias("ts"), *[F.col(f"pollution.{c}").alias(c)
                                                              for c in POLLUTION_FIELDS])
    if second is None:
        out = out.withColumn("second_source", fallback)
    else:
        s = second.select(*keys, F.struct(*[c for c in second.columns if c not in keys]).alias("__s"))
        out = out.join(s, keys, "left")
        own_ts = F.col(ts) if ts in weather.columns else F.col("pollution.ts")
        sec = F.when(F.col("__s").isNotNull(), F.struct(
            own_ts.alias("ts"), *[F.col(f"__s.{c}").alias(c) for c in POLLUTION_FIELDS]))
        out = out.withColumn("second_source", F.coalesce(sec, fallback)).drop("__s")
    return out.withColumn("source", F.lit(source))


def flatten_defaults(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Nested reading -> 14 flat measures; a missing value is 0 (live path)."""
    keys = [c for c in df.columns if c not in ("weather", "pollution", "second_source", "source")]
    wf = {f.name for f in df.schema["weather"].dataType.fields}
    pf = {f.name for f in df.schema["pollution"].dataType.fields}
    out = [F.col(c) for c in keys]
    for c in S.FLAT_MEASURES[:7]:
        out.append(_zero(F.col(f"weather.{c}") if c in wf else F.lit(None)).alias(c))
    for c in S.FLAT_MEASURES[7:]:
        out.append(_zero(F.col(f"pollution.{c}") if c in pf else F.lit(None)).alias(c))
    return df.select(*out)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested reading -> flat; missing stays NULL. Pollution AQI -> ``aqi_openweather``,
    second-source AQI -> ``aqi_aqicn`` (backfill path)."""
    out = {}
    if "weather" in df.columns:
        wf = {f.name for f in df.schema["weather"].dataType.fields}
        for c in ["temperature", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
                  "visibility", "clouds"]:
            if c in wf:
                out[c] = F.col(f"weather.{c}")
    if "pollution" in df.columns:
        pf = {f.name for f in df.schema["pollution"].dataType.fields}
        for c in ["pm25", "pm10", "o3", "no2", "so2", "co"]:
            if c in pf:
                out[c] = F.col(f"pollution.{c}")
        if "aqi" in pf:
            out["aqi_openweather"] = F.col("pollution.aqi")
    if "second_source" in df.columns:
        sf = {f.name for f in df.schema["second_source"].dataType.fields}
        if "aqi" in sf:
            out["aqi_aqicn"] = F.col("second_source.aqi")
    flat = df.withColumns(out).drop(*[c for c in ("weather", "pollution", "second_source") if c in df.columns])
    if "ts" not in flat.columns and "timestamp" not in flat.columns:
        flat = flat.withColumn("ts", F.localtimestamp())
    return flat
