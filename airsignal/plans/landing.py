"""Feed documents derived from ``events`` (one document per event).

The feeds of the reference are JSON documents; here Spark writes them with
``to_json`` from the event columns, so every parsing query reads the whole test
table and the DuckDB oracle can compute the same values from the flat columns.
Some fields are left out on purpose (defaults), some documents are errors or
not JSON at all (rejected rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsignal.plans.frames import table


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def _epoch() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """One shuffle by the join keys: the three feeds are then joined without another exchange (and share this one)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated: the rows are small, the documents made of them are not
    return table(spark, sf, "events").select(F.col("user_id").alias("location_id"), "event_id", "ts",
                                             "event_type", "value", "props").repartition(n, "location_id", "event_id")


def _broken(doc: Column, lacking: Column) -> Column:
    """Every 89th document is not JSON, every 83rd lacks what its feed needs."""
    eid = F.col("event_id")
    return F.when(eid % 89 == 0, F.lit("not json")).when(eid % 83 == 0, lacking).otherwise(doc)


#: SQL condition of the same documents.
BROKEN_SQL = "(event_id % 89 = 0 OR event_id % 83 = 0)"


def weather_docs(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    e = _base(spark, sf)
    v, et, eid = F.col("value"), F.col("event_type"), F.col("event_id")
    doc = F.struct(
        F.struct(v.alias("temp"), (v - 1).alias("feels_like"), _k().alias("humidity"),
                 (F.lit(1000.0) + eid % 30).alias("pressure")).alias("main"),
        F.struct((v / 10).alias("speed"), F.when(et != "click", (eid % 360).cast("double")).alias("deg")).alias("wind"),
        F.array(F.struct(et.alias("description"),
                         F.concat(F.lit("0"), (eid % 9).cast("string"), F.lit("d")).alias("icon"))).alias("weather"),
        F.when(et != "view", (F.lit(10000) - eid % 5000).cast("double")).alias("visibility"),
        F.struct((eid % 101).cast("double").alias("all")).alias("clouds"),
        F.struct((_epoch() - 21600).alias("sunrise"), (_epoch() + 21600).alias("sunset")).alias("sys"),
    )
    text = F.to_json(doc)
    if broken:
        text = _broken(text, F.to_json(F.struct(F.struct(v.alias("temp")).alias("main"))))
    return e.select("location_id", "event_id", "ts", text.alias("json"))


def pollution_docs(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    e = _base(spark, sf)
    v, et, eid = F.col("value"), F.col("event_type"), F.col("event_id")
    item = F.struct(
        _epoch().alias("dt"),
        F.struct((eid % 7).alias("aqi")).alias("main"),
        F.struct(v.alias("pm2_5"), F.when(et != "signup", v * 2).alias("pm10"), _k().alias("o3"),
                 (v / 2).alias("no2"), F.when(eid % 3 != 0, _k() / 3).alias("so2"), (v * 10).alias("co"),
                 F.when(et == "error", F.lit(1.5)).alias("nh3")).alias("components"),
    )
    text = F.to_json(F.struct(F.array(item).alias("list")))
    if broken:
        text = _broken(text, F.lit('{"list": []}'))
    return e.select("location_id", "event_id", "ts", text.alias("json"))


def second_docs(spark: SparkSession, sf: str) -> DataFrame:
    e = _base(spark, sf)
    v, eid = F.col("value"), F.col("event_id")
    vals = {"pm25": v, "pm10": _k(), "o3": F.when(eid % 4 != 0, v / 3), "no2": v / 5, "so2": F.lit(None),
            "co": v * 2, "t": v / 4, "h": _k() / 2, "p": F.lit(1013.0), "w": F.when(eid % 5 != 0, v / 20),
            "wg": F.lit(None)}
    iaqi = F.map_filter(F.create_map(*[x for n, c in vals.items()
                                       for x in (F.lit(n), F.struct(c.cast("double").alias("v")))]),
                        lambda k, s: s.getField("v").isNotNull())
    # a document without a status is as good as one that says ok
    ok = F.to_json(F.struct(F.when(eid % 7 != 0, F.lit("ok")).alias("status"),
                            F.struct((v * 1.5).alias("aqi"), iaqi.alias("iaqi")).alias("data")))
    err = F.to_json(F.struct(F.lit("error").alias("status"), F.lit("Unknown station").alias("data")))
    doc = F.when(eid % 97 == 0, F.lit("not json")).when(eid % 10 == 0, err).otherwise(ok)
    return e.select("location_id", "event_id", "ts", doc.alias("json"))


def forecast_docs(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    e = _base(spark, sf)
    v, et = F.col("value"), F.col("event_type")

    def item(i: Column) -> Column:
        return F.struct(
            (_epoch() + i * 10800).alias("dt"),
            F.struct((v + i).alias("temp"), _k().alias("humidity"), (F.lit(1000.0) + i).alias("pressure")).alias("main"),
            F.struct((v / 10).alias("speed"), F.when(i != 1, (i * 90).cast("double")).alias("deg")).alias("wind"),
            F.array(F.struct(et.alias("description"), F.lit("01d").alias("icon"))).alias("weather"),
            F.struct((i * 10).cast("double").alias("all")).alias("clouds"),
            F.when(i == 2, F.lit(0.5)).alias("pop"),
        )

    doc = F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), item).alias("list"))
    text = F.to_json(doc)
    if broken:
        text = _broken(text, F.lit('{"city": 1}'))
    return e.select("location_id", "event_id", text.alias("json"))


# SQL views of the same documents' flat values, for the oracle
K_SQL = "CAST(json_extract(props, '$.k') AS DOUBLE)"
EPOCH_SQL = "(epoch_us(ts) // 1000000)"


def write_landing(df: DataFrame, path: str, files: int = 12) -> str:
    """Write documents as JSON-lines files (several files, so a stream reads several micro-batches)."""
    df.repartition(files).write.mode("overwrite").json(path)
    return path
