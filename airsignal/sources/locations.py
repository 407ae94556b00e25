"""Location catalogue as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def location_dim(catalogue: DataFrame) -> DataFrame:
    """``country_code, name, cities MAP<city, STRUCT<latitude, longitude, timezone>>`` rows -> one row per city.

    Sorted by country and city; ``location_id`` = '<country>/<city>'.
    """
    ex = catalogue.select("country_code", F.col("name").alias("country_name"),
                          F.explode("cities").alias("city", "__c"))
    return ex.select("country_code", "country_name", "city", F.col("__c.latitude").alias("latitude"),
                     F.col("__c.longitude").alias("longitude"), F.col("__c.timezone").alias("timezone"),
                     F.concat_ws("/", "country_code", "city").alias("location_id")) \
        .orderBy("country_code", "city")


def countries(dim: DataFrame) -> DataFrame:
    return dim.select("country_code", "country_name").distinct().orderBy("country_code")


def cities(dim: DataFrame, country_code: str) -> DataFrame:
    return dim.filter(F.col("country_code") == country_code).select("city").orderBy("city")


def location_lookup(readings: DataFrame, dim: DataFrame, on: str | list, how: str = "inner") -> DataFrame:
    """Attach city, country and coordinates; unknown locations give no row.

    A plain equi-join: the planner broadcasts the dimension when its size in bytes is below the session's threshold.
    """
    return readings.join(dim, on, how)
