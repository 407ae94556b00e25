"""Driver contract."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"aqi", "aqi_lag_1", "aqi_rolling_mean_24h", "category"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
