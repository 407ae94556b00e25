"""Explicit schemas of the feed documents and the stored tables (no inference)."""

from pyspark.sql.types import (ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType,
                               TimestampNTZType)

D, L, S = DoubleType(), LongType(), StringType()


def struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


WEATHER_DOC = struct(
    main=struct(temp=D, feels_like=D, humidity=D, pressure=D),
    wind=struct(speed=D, deg=D),
    weather=ArrayType(struct(description=S, icon=S)),
    visibility=D,
    clouds=struct(all=D),
    sys=struct(sunrise=L, sunset=L),
)

POLLUTION_DOC = struct(
    list=ArrayType(struct(
        dt=L,
        main=struct(aqi=L),
        components=struct(pm2_5=D, pm10=D, o3=D, no2=D, so2=D, co=D, nh3=D),
    ))
)

SECOND_ENVELOPE = struct(status=S, data=S)  # data: an object, or an error text
SECOND_DATA = struct(aqi=D, iaqi=MapType(S, struct(v=D)))
SECOND_MEASURES = ["pm25", "pm10", "o3", "no2", "so2", "co", "t", "h", "p", "w", "wg"]

FORECAST_DOC = struct(
    list=ArrayType(struct(
        dt=L,
        main=struct(temp=D, humidity=D, pressure=D),
        wind=struct(speed=D, deg=D),
        weather=ArrayType(struct(description=S, icon=S)),
        clouds=struct(all=D),
        pop=D,
    ))
)

WEATHER = struct(temperature=D, feels_like=D, humidity=D, pressure=D, wind_speed=D, wind_direction=D,
                 description=S, icon=S, visibility=D, clouds=D, sunrise=TimestampNTZType(), sunset=TimestampNTZType())
POLLUTION = struct(ts=TimestampNTZType(), aqi=D, pm25=D, pm10=D, o3=D, no2=D, so2=D, co=D, nh3=D)
SECOND = struct(ts=TimestampNTZType(), aqi=D, pm25=D, pm10=D, o3=D, no2=D, so2=D, co=D,
                t=D, h=D, p=D, w=D, wg=D)

FLAT_MEASURES = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "clouds",
                 "aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]
