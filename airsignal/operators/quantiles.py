"""Exact quantiles per key by narrowing histograms: no task or buffer holds the values of a key.

A double has a 64-bit image in the same order. Each round counts the rows of every target, a range of images known by its leading bits, by their
next ``BITS`` bits (combined before the shuffle), and keeps of each wanted rank the bucket it falls into. After 64 / BITS rounds a bucket is one value. A round reads
the rows once; what is kept between rounds is one row per key, column and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from airsignal.operators.series import join_null_safe
from airsignal.session import reliable

BITS = 16


@F.pandas_udf(LongType())
def image_of(x: pd.Series) -> pd.Series:
    """Order-preserving long of a double: -inf ... inf, then NaN; both zeros alike."""
    v = x.to_numpy(dtype=np.float64) + 0.0
    b = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(DoubleType())
def value_of(i: pd.Series) -> pd.Series:
    b = i.to_numpy(dtype=np.int64)
    return pd.Series((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def exact_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q0_0, q0_1, ...): interpolated quantiles ``shares`` of every column (q<column>_<share> by place), one row per key; NULL without values.

    Rank (n - 1) x share between its two neighbours, as ``percentile``; NULLs do not count.
    """
    keys = list(keys)
    key = [f"__k{i}" for i in range(len(keys))]
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    long = (df.select(*[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], F.explode(pairs).alias("__p"))
            .select(*key, "__p.c", "__p.x").where("x IS NOT NULL").select(*key, "c", image_of("x").alias("image")))
    at = [*key, "c"]
    # wanted ranks: floor and ceiling of (n - 1) x share
    n = long.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])
    place = (F.col("n") - 1) * F.col("__s.p")
    ends = F.array(F.struct(F.lit(0).alias("e"), F.floor(place).cast("long").alias("rank")), F.struct(F.lit(1).alias("e"), F.ceil(place).cast("long").alias("rank")))
    want = (n.select(*at, "n", F.explode(each).alias("__s")).select(*at, F.col("__s.s").alias("s"), (place - F.floor(place)).alias("part"), F.explode(ends).alias("__e"))
            .select(*at, "s", "part", "__e.e", "__e.rank", F.lit(0).cast("long").alias("prefix")))
    want = reliable(want)
    for left in range(64 - BITS, -1, -BITS):
        lead, digit = F.shiftright("image", left + BITS) if left + BITS < 64 else F.lit(0).cast("long"), F.shiftright("image", left)
        digit = digit if left + BITS == 64 else digit.bitwiseAND(F.lit((1 << BITS) - 1))
        rows = long.select(*at, lead.alias("prefix"), digit.alias("digit"))
        if left + BITS < 64:
            rows = join_null_safe(rows, want.select(*at, "prefix").distinct(), [*at, "prefix"], "left_semi")
        counts = rows.groupBy(*at, "prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(*at, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** BITS rows at most
        counts = counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
        met = join_null_safe(want, counts, [*at, "prefix"]).where("rank >= below and rank < below + n")
        step = F.col("digit") if left + BITS == 64 else F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit"))
        want = reliable(met.select(*at, "s", "part", "e", (F.col("rank") - F.col("below")).alias("rank"), step.alias("prefix")))
    found = want.withColumn("v", value_of("prefix"))
    pick = lambda c, s, e: F.max(F.when((F.col("c") == c) & (F.col("s") == s) & (F.col("e") == e), F.col("v")))
    part = lambda c, s: F.max(F.when((F.col("c") == c) & (F.col("s") == s), F.col("part")))
    out = []
    for c in range(len(cols)):
        for s in range(len(shares)):
            low, high, p = pick(c, s, 0), pick(c, s, 1), part(c, s)
            out.append(F.when((low == high) | (p == 0), low).otherwise((F.lit(1.0) - p) * low + p * high).alias(f"q{c}_{s}"))
    return found.groupBy(*key).agg(*out).withColumnsRenamed(dict(zip(key, keys, strict=True)))
