"""Window features written as SQL text over the series window equal the Column API.

Covers what the SQL rendering adds: no PARTITION BY for a single series (``keys=[]``),
identifiers that need quoting, and the blocked plan's window (block key, row number).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from airsignal.operators import windows as W
from airsignal.operators.series import plan_series, quote
from tests.conftest import SF, approx_rows, collect_sorted


def _readings(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select(F.col("user_id").alias("loc id"), "ts", "event_id",
                    F.when(F.col("event_type") != "view", F.col("value")).alias("pm`25"))


def test_quote():
    assert quote("a") == "`a`"
    assert quote("pm`25") == "`pm``25`"


def test_over_text(spark):
    df = _readings(spark)
    p = plan_series(df, ["loc id"], ["ts", "event_id"], 3, "plain")
    assert p.over() == "OVER (PARTITION BY `loc id` ORDER BY `ts`, `event_id`)"
    single = plan_series(df, [], ["ts", "event_id"], 3, "plain")
    assert single.over("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW") == \
        "OVER (ORDER BY `ts`, `event_id` ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    blocked = plan_series(df, ["loc id"], ["ts", "event_id"], 3, "blocked", block_rows=50)
    assert blocked.over() == "OVER (PARTITION BY `loc id`, `__blk` ORDER BY `__rn`)"


def _expected(df, keys, order):
    c = F.col("`pm``25`")
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.select(*keys, *order, c.alias("v"),
                     F.lag(c, 2).over(w).alias("lag2"),
                     (c - F.lag(c, 1).over(w)).alias("chg"),
                     F.avg(c).over(w.rowsBetween(-4, 0)).alias("mean5"),
                     F.stddev_samp(c).over(w.rowsBetween(-4, 0)).alias("std5"),
                     F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ff"))


def _actual(df, keys, order, strategy):
    a = W.lag_features(df, ["pm`25"], (2,), keys, order[0], tie=order[1:], strategy=strategy, block_rows=40)
    a = W.change_rate(a, ["pm`25"], keys, order[0], tie=order[1:], strategy=strategy, block_rows=40)
    a = W.rolling(a, ["pm`25"], 5, ("mean", "std"), keys, order[0], tie=order[1:], strategy=strategy,
                  block_rows=40, suffix="5")
    a = a.withColumn("ff", F.col("`pm``25`"))
    a = W.ffill(a, ["ff"], keys, order[0], tie=order[1:], strategy=strategy, block_rows=40)
    return a.select(*keys, *order, F.col("`pm``25`").alias("v"), F.col("`pm``25_lag_2`").alias("lag2"),
                    F.col("`pm``25_change_rate`").alias("chg"), F.col("`pm``25_rolling_mean_5`").alias("mean5"),
                    F.col("`pm``25_rolling_std_5`").alias("std5"), "ff")


def test_single_series_and_quoted_names(spark):
    df = _readings(spark)
    order = ["ts", "event_id"]
    for keys in ([], ["loc id"]):
        exp = collect_sorted(_expected(df, keys, order), [*keys, *order])
        for strategy in ("plain", "blocked"):
            got = collect_sorted(_actual(df, keys, order, strategy), [*keys, *order])
            approx_rows(got, exp)
