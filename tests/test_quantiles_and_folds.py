"""Exact quantiles, rolling-origin folds, ingest of good and rejected documents in one pass."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airsignal.ml import models as M
from airsignal.operators.quantiles import exact_quantiles, image_of, value_of
from airsignal.session import scratch_path
from airsignal.streaming import streams as ST


def test_quantiles_against_percentile(spark):
    """Heavy tails, equal values, one value, none; keys that are null; a hot key."""
    rng = np.random.default_rng(0)
    rows = [(int(k) if k else None, float(v), float(w) if w > 0.3 else None) for k, v, w in
            zip(rng.choice([0, 1, 2, 3], 3000, p=[.02, .9, .05, .03]), np.exp(rng.normal(size=3000) * 30) * rng.choice([-1, 1], 3000), rng.random(3000).round(2))]
    rows += [(7, 5.0, None), (8, 0.0, 1.0), (8, -0.0, 1.0), (9, math.inf, 2.0), (9, -math.inf, 2.0), (9, 1e-320, 3.0), (9, 4.0, 2.0)]
    d = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = {r.k: r for r in exact_quantiles(d, ["a", "b"], shares, ["k"]).collect()}
    for r in d.groupBy("k").agg(*[F.percentile(c, F.lit(p)).alias(f"q{i}_{j}") for i, c in enumerate("ab") for j, p in enumerate(shares)]).collect():
        for i in range(2):
            for j in range(len(shares)):
                x, y = r[f"q{i}_{j}"], got[r.k][f"q{i}_{j}"]
                assert (x is None and y is None) or x == y or (x is not None and (math.isnan(x) or x == pytest.approx(y, rel=1e-12))), (r.k, i, j, x, y)
    assert len(got) == 7
    one = exact_quantiles(d, ["a"], (0.5,)).first()
    assert one.q0_0 == pytest.approx(float(np.median([a for _, a, _ in rows])), rel=1e-12)


def test_images_keep_the_order(spark):
    xs = sorted([0.0, 1.0, -1.0, 1e-320, -1e-320, 1e300, -1e300, math.inf, -math.inf, 0.1, 0.1 + 2 ** -55])
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", image_of("x").alias("i")).select("x", "i", value_of("i").alias("back")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.i)] == xs and all(r.x == r.back for r in rows)


def test_folds(spark):
    d = spark.range(24 * 60).selectExpr("id % 3 as location_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", "id")
    rows = M.rolling_folds(d, 4, 48.0, 0.5).collect()
    for k in range(4):
        train, val = ([r.id for r in rows if r.fold == k and r.part == p] for p in ("train", "validation"))
        assert min(val) == 720 + 180 * k and len(val) == 180 and max(train) < min(val) - 48 and max(train) >= min(val) - 50 and min(train) == 0
    assert M.rolling_folds(d.limit(0), 4).count() == 0


def test_validation_respects_time(spark):
    """A feature that is the label of its neighbours in time looks good by random folds and is found out by rolling ones."""
    rng = np.random.default_rng(1)
    level = np.repeat(rng.normal(size=40), 25)
    n = len(level)
    rows = [(i, Vectors.dense(np.eye(40)[i // 25].tolist()), float(level[i])) for i in range(n)]
    d = spark.createDataFrame(rows, ["id", "features", "label"])
    d = d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))"))
    random, rolling = (M.cross_validate(d, LinearRegression(regParam=1e-6), {"maxIter": [5, 20]}, 3, ts=ts, gap_hours=30) for ts in (None, "ts"))
    assert min(random.avgMetrics) < 0.2 < min(rolling.avgMetrics)
    assert rolling.transform(d).count() == n and len(rolling.foldMetrics[0]) == 3
    with pytest.raises(ValueError):
        M.cross_validate(d, LinearRegression(), {}, 3, ts="ts", gap_hours=10_000)


def test_ingest_in_one_pass(spark):
    land, out, bad, ckpt = (scratch_path(spark, n) for n in ("land", "out", "bad", "ckpt"))
    docs = [(str(k), str(k), f"2024-01-0{1 + k % 3} 00:00:00", json.dumps({"list": [{"dt": 1, "main": {"aqi": 2}, "components": {"pm10": float(k)}}]}) if k % 4 else "broken") for k in range(40)]
    spark.createDataFrame(docs, "location_id string, event_id string, ts string, json string").repartition(4).write.json(land)
    ST.stream_ingest(spark, land, out, ckpt, "pollution", bad, max_files=2)
    good = sorted(r.pm10 for r in ST.read_ingested(spark, out).collect())
    assert good == [float(k) for k in range(40) if k % 4] and ST.read_ingested(spark, bad).count() == 10
    # a batch that is run again replaces itself
    batch = spark.read.schema(ST.LANDING).json(land).selectExpr("cast(location_id as long) location_id", "cast(event_id as long) event_id", "to_timestamp_ntz(ts) ts", "json")
    sink = ST.ingest_sink(out, "pollution", bad)
    sink(batch.filter("event_id < 8"), 99)
    once = (ST.read_ingested(spark, out).count(), ST.read_ingested(spark, bad).count())
    sink(batch.filter("event_id < 8"), 99)
    assert (ST.read_ingested(spark, out).count(), ST.read_ingested(spark, bad).count()) == once == (36, 12)
