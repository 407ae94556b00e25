"""Loads every query module and exposes the registry and the flagship query."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from airsignal.plans.registry import REGISTRY, Query

MODULES = [
    "airsignal.plans.q_columns",
    "airsignal.plans.q_windows",
    "airsignal.plans.q_features",
    "airsignal.plans.q_insights",
    "airsignal.plans.q_sources",
    "airsignal.plans.q_store",
    "airsignal.plans.q_models",
    "airsignal.plans.q_streams",
    "airsignal.plans.q_jobs",
]


def registry() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(m)
    return dict(REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from airsignal.functions import columns as C
    from airsignal.operators import windows as W
    from airsignal.plans.frames import obs_wide

    d = obs_wide(spark, sf_dir)
    d = C.calendar_parts(d, "ts")
    d = W.lag_features(d, ["aqi", "pm25"], (1, 2, 3), ["location_id"], "ts", strategy="plain")
    d = W.rolling(d, ["aqi"], 24, ("mean", "max"), ["location_id"], "ts", strategy="plain")
    return d.withColumn("category", C.aqi_category(F.col("aqi")))
