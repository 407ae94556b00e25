"""The skew-safe blocked plan must give exactly the plain plan's values."""

from pyspark.sql import functions as F

from airsignal.operators import windows as W
from airsignal.operators.series import series_row_number
from airsignal.plans.frames import SERIES, obs_long, obs_wide
from tests.conftest import SF01, approx_rows, collect_sorted

K = ["location_id"]


def test_row_number_exact(spark):
    d = obs_long(spark, SF01)
    got = series_row_number(d, K, ["ts", "event_id"], chunk_seconds=3600)
    ref = d.withColumn("__rn", F.row_number().over(
        __import__("pyspark.sql").sql.Window.partitionBy(*K).orderBy("ts", "event_id")))
    assert collect_sorted(got.select("event_id", "__rn"), ["event_id"]) == \
        collect_sorted(ref.select("event_id", "__rn"), ["event_id"])


def test_blocked_equals_plain_windows(spark):
    d = obs_wide(spark, SF01).select("location_id", "ts", *SERIES)
    for fn in (
        lambda s, b: W.lag_features(d, SERIES, (1, 2, 3), K, "ts", strategy=s, block_rows=b),
        lambda s, b: W.rolling(d, ["aqi", "pm25"], 24, ("mean", "std", "min", "max"), K, "ts", strategy=s, block_rows=b),
        lambda s, b: W.change_rate_pct(d, ["aqi", "pm10"], K, "ts", strategy=s, block_rows=b),
        lambda s, b: W.fill_missing(d, SERIES, K, "ts", strategy=s, block_rows=b),
    ):
        plain = fn("plain", None)
        blocked = fn("blocked", 29)
        assert blocked.columns == plain.columns
        approx_rows(collect_sorted(blocked, ["location_id", "ts"]), collect_sorted(plain, ["location_id", "ts"]))


def test_single_series_blocked(spark):
    """keys=[]: the reference's single series, split into blocks instead of one task."""
    d = obs_long(spark, SF01).select("event_id", "ts", "value")
    plain = W.rolling(d, ["value"], 168, ("mean", "std"), [], "ts", tie=["event_id"], strategy="plain")
    blocked = W.rolling(d, ["value"], 168, ("mean", "std"), [], "ts", tie=["event_id"], strategy="blocked",
                        block_rows=500)
    approx_rows(collect_sorted(blocked, ["event_id"]), collect_sorted(plain, ["event_id"]))


def test_trend_blocked(spark):
    d = obs_wide(spark, SF01)
    a = W.head_tail_trend(d, "aqi", K, "ts", strategy="plain")
    b = W.head_tail_trend(d, "aqi", K, "ts", strategy="blocked", block_rows=7)
    approx_rows(collect_sorted(b, K), collect_sorted(a, K))


def test_rolling_time_blocked(spark):
    d = obs_wide(spark, SF01).select("location_id", "ts", "aqi")
    a = W.rolling_time(d, ["aqi"], 24, keys=K, ts="ts", strategy="plain")
    b = W.rolling_time(d, ["aqi"], 24, keys=K, ts="ts", strategy="blocked", bucket_hours=48)
    approx_rows(collect_sorted(b, ["location_id", "ts"]), collect_sorted(a, ["location_id", "ts"]))


def test_derived_features_blocked_equals_plain(spark):
    from airsignal.operators.features import derived_features

    d = obs_wide(spark, SF01).select("location_id", "ts", *SERIES)
    plain = derived_features(d, K, "ts", strategy="plain")
    blocked = derived_features(d, K, "ts", strategy="blocked", block_rows=211)
    assert blocked.columns == plain.columns
    approx_rows(collect_sorted(blocked, ["location_id", "ts"]), collect_sorted(plain, ["location_id", "ts"]), 1e-7)


def test_session_chooses_the_strategy(spark):
    """A third of all events on one location: the session's strategy decides, values are the same, no job sizes the input."""
    from airsignal.operators.series import plan_series

    d = obs_long(spark, SF01).withColumn(
        "location_id", F.when(F.col("location_id") % 3 == 0, F.lit(0)).otherwise(F.col("location_id")))
    assert not plan_series(d, K, ["ts", "event_id"], 23).blocked
    spark.conf.set("airsignal.series.strategy", "blocked")
    spark.conf.set("airsignal.series.blockRows", "400")
    try:
        assert plan_series(d, K, ["ts", "event_id"], 23).blocked
        chosen = W.rolling(d, ["value"], 24, ("mean", "max"), K, "ts", tie=["event_id"])
    finally:
        spark.conf.unset("airsignal.series.strategy")
        spark.conf.unset("airsignal.series.blockRows")
    plain = W.rolling(d, ["value"], 24, ("mean", "max"), K, "ts", tie=["event_id"], strategy="plain")
    approx_rows(collect_sorted(chosen, ["event_id"]), collect_sorted(plain, ["event_id"]))


def test_null_keys_and_times_are_kept(spark):
    rows = [(None if i % 5 == 0 else i % 3, None if i == 7 else i, float(i) if i % 4 else None) for i in range(50)]
    d = spark.createDataFrame(rows, "location_id int, ts int, v double")
    out = {s: collect_sorted(W.lag_features(W.ffill(d, ["v"], K, "ts", strategy=s, block_rows=3), ["v"], (1, 2), K, "ts",
                                            strategy=s, block_rows=2), ["location_id", "ts"]) for s in ("plain", "blocked")}
    assert len(out["plain"]) == 50 and out["plain"] == out["blocked"]


def test_look_back_longer_than_a_block(spark):
    d = spark.range(40).selectExpr("1 as location_id", "id as ts", "cast(id as double) as v")
    a = W.rolling(d, ["v"], 30, ("mean",), K, "ts", strategy="blocked", block_rows=4)
    b = W.rolling(d, ["v"], 30, ("mean",), K, "ts", strategy="plain")
    approx_rows(collect_sorted(a, ["ts"]), collect_sorted(b, ["ts"]))
