"""History insights, badges, display formatting, ranking and model metrics.

All are aggregates (partial + final hash aggregation, so a hot location is
pre-aggregated map-side) or narrow projections. Per-key results come from
``groupBy(keys)``; ``keys=[]`` gives the reference's single global answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsignal.functions import columns as C

# Fixed badge tiers of the reference dashboard: (bound, label) checked in order, then the fallback.
BADGES = {
    "records": ([(100, "Data Collector"), (50, "Data Enthusiast")], "Beginner", ">="),
    "average": ([(30, "Clean Air Champion"), (60, "Air Quality Aware")], "Air Quality Monitor", "<="),
    "maximum": ([(50, "Safety Guardian"), (100, "Air Quality Watcher")], "Air Quality Alert", "<="),
    "minimum": ([(20, "Perfect Air Seeker"), (40, "Clean Air Explorer")], "Air Quality Learner", "<="),
}


def _tier(c: Column, tiers, fallback: str, op: str) -> Column:
    e = None
    for bound, label in tiers:
        cond = c >= bound if op == ">=" else c <= bound
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e.otherwise(fallback)


def badge_tiers(df: DataFrame, keys: Sequence[str] = (), value: str = "aqi") -> DataFrame:
    """Record count, mean, max and min of ``value`` and the badge of each."""
    v = F.col(value)
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"), F.avg(v).alias("avg_value"),
                                F.max(v).alias("max_value"), F.min(v).alias("min_value"))
    src = {"records": "total_records", "average": "avg_value", "maximum": "max_value", "minimum": "min_value"}
    return agg.withColumns({f"{k}_badge": _tier(F.col(src[k]), *BADGES[k]) for k in BADGES})


def binary_round(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` decimals by its exact binary value, ties to even (what ``%.1f`` does in C and Python).

    The JVM rounds the shortest decimal text half up instead, so 0.25 would become 0.3. The product with the power
    of ten is taken as a double and its exact error (the factor split in two halves), which decides near ties.
    """
    ten = F.lit(float(10 ** digits))
    a = F.abs(x)
    p = a * ten
    high = a * F.lit(134217729.0)
    high = high - (high - a)
    error = (high * ten - p) + (a - high) * ten
    low = F.floor(p).cast("double")
    part = p - low
    half = (part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1.0)))
    n = low + F.when((part > 0.5) | half, 1.0).otherwise(0.0)
    return F.when(a < 1e14, F.signum(x) * n / ten).otherwise(x)


def format_display(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{col: (new_name, kind)}``; kind 'datetime' -> 'yyyy-MM-dd HH:mm', '1f' -> one decimal, 'text' as is.

    Decimals are rounded as the exact binary value of the double stands, ties to even (0.25 -> 0.2,
    0.35 -> 0.3, 1234.55 -> 1234.5); NULL stays NULL.
    """
    out = []
    for c, (name, kind) in spec.items():
        if kind == "datetime":
            out.append(F.date_format(F.col(c), "yyyy-MM-dd HH:mm").alias(name))
        elif kind.endswith("f"):
            d = int(kind[:-1])
            out.append(F.when(F.col(c).isNotNull(), F.format_string(f"%.{d}f", binary_round(F.col(c).cast("double"), d))).alias(name))
        else:
            out.append(F.col(c).alias(name))
    return df.select(*out)


def history_overview(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "aqi") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.to_date(F.min(ts)).alias("first_date"),
        F.to_date(F.max(ts)).alias("last_date"),
        F.avg(value).alias("avg_aqi"),
    )


def hourly_profile(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "aqi") -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).cast("int").alias("hour")).agg(F.avg(value).alias("avg_aqi"))


def best_worst_hour(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "aqi") -> DataFrame:
    """Hour of day with the highest / lowest mean; ties go to the earliest hour."""
    prof = hourly_profile(df, keys, ts, value).filter(F.col("avg_aqi").isNotNull())
    hi = F.struct(F.col("avg_aqi"), -F.col("hour"))
    lo = F.struct(F.col("avg_aqi"), F.col("hour"))
    return prof.groupBy(*keys).agg(
        F.max_by("hour", hi).alias("worst_hour"), F.max("avg_aqi").alias("worst_avg_aqi"),
        F.min_by("hour", lo).alias("best_hour"), F.min("avg_aqi").alias("best_avg_aqi"),
    )


def pearson(x: Column, y: Column) -> tuple[Column, ...]:
    """Aggregates for r on pairwise complete rows; zero variance gives NULL instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return (F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy)),)


def weather_correlation(df: DataFrame, xs: Sequence[str] = ("temperature", "humidity"), y: str = "aqi",
                        keys: Sequence[str] = (), threshold: float = 0.3) -> DataFrame:
    """Pearson r of each x with y; relation 'positive' / 'negative' when |r| > threshold, else 'weak'."""
    agg = df.groupBy(*keys).agg(*[pearson(F.col(x), F.col(y))[0].alias(f"{x}_corr") for x in xs])
    rel = {}
    for x in xs:
        r = F.col(f"{x}_corr")
        rel[f"{x}_relation"] = F.when(F.abs(r) > threshold, F.when(r > 0, "positive").otherwise("negative")) \
            .otherwise("weak")
    return agg.withColumns(rel)


def column_means(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the mean of each column (same names)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def max_forecast_category(forecast: DataFrame, keys: Sequence[str] = (), value: str = "aqi") -> DataFrame:
    """Category and advice for the highest forecast value of each key."""
    m = forecast.groupBy(*keys).agg(F.max(value).alias("max_aqi"))
    m = m.withColumn("category", C.aqi_category("max_aqi"))
    return C.category_attributes(m, "category").drop("color")


def latest_reading(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """The newest row of each key (``max_by`` of the whole row, no sort); of rows of equal time the largest by the other columns, in their order."""
    others = [c for c in df.columns if c not in keys]
    ranked = [c for c, t in df.dtypes if c in others and c != ts and "map<" not in t and t not in ("variant", "void")]
    row = F.max_by(F.struct(*[F.col(c) for c in others]), F.when(F.col(ts).isNotNull(), F.struct(ts, *ranked))).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def sort_by_time(df: DataFrame, ts: str = "ts", asc: bool = True, keys: Sequence[str] | None = None) -> DataFrame:
    """Global order by ts; with ``keys`` only within each location's partition (no range shuffle)."""
    o = F.col(ts).asc() if asc else F.col(ts).desc()
    if keys:
        return df.repartition(*keys).sortWithinPartitions(*keys, o)
    return df.orderBy(o)


def top_features(importance: DataFrame, n: int = 10, value: str = "importance", name: str = "feature") -> DataFrame:
    """Top n by importance, descending (TakeOrderedAndProject: a per-partition top-n, then a merge)."""
    return importance.orderBy(F.col(value).desc(), F.col(name).asc()).limit(n)


def first_cap(df: DataFrame, ts: str = "ts", n: int = 1000, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(ts, *tie).limit(n)


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2 (1 - SSE/SST) and MAPE in % (y = 0 rows skipped) over rows with both values."""
    both = F.col(label).isNotNull() & F.col(pred).isNotNull()
    y, p = F.when(both, F.col(label)), F.when(both, F.col(pred))
    err = y - p
    agg = df.groupBy(*keys).agg(
        F.count(err).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("__sse"),
        (F.var_pop(y) * F.count(y)).alias("__sst"),
        (F.avg(F.abs(F.try_divide(err, F.when(y != 0, y)))) * F.lit(100.0)).alias("mape"),
    )
    return agg.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__sst"))).drop("__sse", "__sst")


def select_best(results: DataFrame, metric: str = "rmse", order: str | None = None) -> DataFrame:
    """Smallest metric; a tie goes to the first entry by ``order``."""
    o = [F.col(metric).asc_nulls_last()] + ([F.col(order).asc()] if order else [])
    return results.orderBy(*o).limit(1)
