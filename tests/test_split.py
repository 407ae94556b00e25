"""The exact random split: by the hash of each part's last row, ranked where rows share it."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airsignal.ml import models as M
from airsignal.operators import series


def ranked(d, keys):
    """Part of every key as a rank over all rows gives it."""
    h = F.pmod(F.xxhash64(*keys, F.lit(42)), F.lit(1 << 53))
    a, b, _ = M.split_sizes(d.count())
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(h, *keys))
    return d.select(*keys, F.when(rn <= a, "train").when(rn <= a + b, "validation").otherwise("test").alias("split"))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 2000])
def test_split_equals_ranks_and_moves_no_row(spark, monkeypatch, n):
    d = spark.range(n).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("id"), (F.col("id") * 7).alias("ts"), F.lit("x").alias("other"))
    want = sorted(ranked(d, ["id", "ts"]).collect(), key=str)
    monkeypatch.setattr(series, "series_row_number", lambda *a, **b: pytest.fail("rows are ranked"))
    out = M.split_random(d, keys=["id", "ts"])
    assert sorted(out.select("id", "ts", "split").collect(), key=str) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("copies, most", [(700, 1 << 20), (7, 10)])
def test_sizes_are_exact_where_rows_share_hashes(spark, monkeypatch, copies, most):
    monkeypatch.setattr(M, "RANGE_ROWS", most)
    d = spark.range(1400).select((F.col("id") % (1400 // copies)).alias("id"), F.lit(0).alias("ts"))
    got = {r.split: r["count"] for r in M.split_random(d, keys=["id", "ts"]).groupBy("split").count().collect()}
    assert [got[k] for k in ("train", "validation", "test")] == M.split_sizes(1400)


def test_no_rows(spark):
    assert M.split_random(spark.range(0).withColumn("ts", F.lit(0)), keys=["id", "ts"]).count() == 0
