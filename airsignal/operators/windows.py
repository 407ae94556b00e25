"""Per-location window features (lags, change rates, rolling frames, fills, trend).

All row-count frames ("24h" = 24 rows, "7d" = 168 rows, as in the reference)
go through :mod:`airsignal.operators.series`, so one operator = one shuffle on
the location keys and one sort, or the skew-safe blocked plan for hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsignal.operators import sliding as SL
from airsignal.operators.series import (BLK, HALO, RN, SeriesPlan, apply_series, attach_row, choose_strategy, join_null_safe,
                                        order_number, plan_series, quote)

ROLL_SUFFIX = {24: "24h", 168: "7d"}
# SQL names of the same statistics (used for wide blocks: one JVM call per expression).
ROLL_SQL = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "count": "count"}
ROLL_STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}


def _order(ts: str, tie: Sequence[str] | None) -> list[str]:
    return [ts, *(tie or [])]


def lag_exprs(plan: SeriesPlan, cols: Iterable[str], lags: Sequence[int] = (1, 2, 3)) -> dict[str, Column]:
    over = plan.over()
    return {f"{c}_lag_{k}": F.expr(f"lag({quote(c)}, {int(k)}) {over}") for c in cols for k in lags}


def change_exprs(plan: SeriesPlan, cols: Iterable[str]) -> dict[str, Column]:
    over = plan.over()
    return {f"{c}_change_rate": F.expr(f"{quote(c)} - lag({quote(c)}, 1) {over}") for c in cols}


def rolling_exprs(plan: SeriesPlan, cols: Iterable[str], rows: int, stats: Sequence[str],
                  suffix: str | None = None) -> dict[str, Column]:
    over = plan.over(f"ROWS BETWEEN {int(rows) - 1} PRECEDING AND CURRENT ROW")
    sfx = suffix or ROLL_SUFFIX.get(rows, f"{rows}r")
    return {f"{c}_rolling_{s}_{sfx}": F.expr(f"{ROLL_SQL[s]}({quote(c)}) {over}") for c in cols for s in stats}


def pct_from_filled(plan: SeriesPlan, filled: dict[str, str]) -> dict[str, Column]:
    """x / previous x - 1 on forward-filled values; previous 0 gives NULL (pandas: inf)."""
    over = plan.over()
    out = {}
    for c, f in filled.items():
        prev = f"lag({quote(f)}, 1) {over}"
        out[f"{c}_change_rate_pct"] = F.expr(
            f"try_divide({quote(f)}, CASE WHEN {prev} != 0 THEN {prev} END) - CAST(1.0 AS DOUBLE)")
    return out


# --- walks over sorted series (linear time) ---------------------------------------

def floating(df: DataFrame, cols: Sequence[str]) -> bool:
    """Whether all the columns are double or float, as the walks take them, and no name needs quotes within a name (Arrow functions refuse those)."""
    types = dict(df.dtypes)
    return bool(cols) and all(types[c] in ("double", "float") for c in cols) and not any("`" in c or "." in c for c in df.columns)


def seed_rows(values: DataFrame, keys: Sequence[str], names: Sequence[str], lasts: Sequence[str] | None, firsts: Sequence[str] | None) -> DataFrame:
    """Seed rows of a walk from columns named ``lasts`` and ``firsts`` (None: nothing known), one per value of the walk."""
    def held(cols: Sequence[str] | None) -> Column:  # SQL text: one JVM call
        if cols is None:
            return F.expr(f"array_repeat(CAST(NULL AS DOUBLE), {len(names)})")
        return F.expr("array(" + ", ".join(f"CAST({quote(c)} AS DOUBLE)" for c in cols) + ")")
    return values.select(*keys, F.lit(0).alias(SL.SEED), held(lasts).alias(SL.LASTS), held(firsts).alias(SL.FIRSTS))


def seeded(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<double>")
    return rows.withColumns({SL.SEED: F.lit(1), SL.LASTS: none, SL.FIRSTS: none}).unionByName(seeds, allowMissingColumns=True)


def walked_series(df: DataFrame, walk: SL.Pass, order: Sequence[str], new: Sequence[str], strategy: str | None = None,
                  block_rows: int | None = None, backward: bool = False) -> DataFrame:
    """``df`` with the columns of a walk, by the plain plan (series whole) or in blocks with halos; both give the same rows.

    Blocks: what the first rows of a block need from before it comes as one seed row per block: the last value of each column in all earlier
    blocks, from a table of one row per block. ``backward`` adds the first value of the whole series.
    """
    names, keys = walk.seed_columns(), list(walk.keys)
    if choose_strategy(df, strategy) == "plain":
        if not backward:
            return SL.walked(df, walk, order, new)
        first = SL.summaries(df, walk, order, "f")
        return SL.walked(seeded(df, seed_rows(first, keys, names, None, [f"__f{j}" for j in range(len(names))])),
                         replace(walk, backward=True), order, new)
    rows = plan_series(df, keys, order, walk.spec.look_back, "blocked", block_rows).df
    cut = [*keys, BLK]
    walk = replace(walk, keys=cut)
    before = f"OVER ({'PARTITION BY ' + ', '.join(map(quote, keys)) if keys else ''} ORDER BY {quote(BLK)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if walk.spec.relative:  # forward-filled series: their last values in earlier blocks
        own = rows.filter(~F.col(HALO)).groupBy(*cut).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"__l{j}") for j, c in enumerate(walk.series)])
        own = own.select(*cut, *[F.expr(f"last(__l{j}, true) {before}").alias(f"__b{j}") for j in range(len(walk.series))])
        known = {c: f"__b{j}" for j, c in enumerate(walk.series)}
        none = own.withColumn("__none", F.lit(None).cast("double"))
        seeds = seed_rows(none, cut, names, [known.get(c, "__none") for c in names], None)
        started = seeded(rows, seeds)
    else:
        started = rows
    if walk.fill:
        ends = SL.summaries(started, walk, [RN])
        whole = before.replace("1 PRECEDING", "UNBOUNDED FOLLOWING")
        ends = ends.select(*cut, *[F.expr(f"last(__l{j}, true) {before}").alias(f"__b{j}") for j in range(len(names))],
                           *[F.expr(f"first(__f{j}, true) {whole}").alias(f"__a{j}") for j in range(len(names))])
        started = seeded(rows, seed_rows(ends, cut, names, [f"__b{j}" for j in range(len(names))], [f"__a{j}" for j in range(len(names))]))
    return SL.walked(started, replace(walk, backward=backward), [RN], new).drop(RN, BLK)


# --- 42-46: public operators ---------------------------------------------------

def lag_features(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3), keys: Sequence[str] = (),
                 ts: str = "ts", tie: Sequence[str] | None = None, strategy: str | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """``<col>_lag_<k>`` = value k rows earlier in the same series."""
    return apply_series(df, keys, _order(ts, tie), max(lags), lambda p: lag_exprs(p, cols, lags),
                        strategy, block_rows)


def change_rate(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "ts",
                tie: Sequence[str] | None = None, strategy: str | None = None, block_rows: int | None = None) -> DataFrame:
    """``<col>_change_rate`` = x - previous x."""
    return apply_series(df, keys, _order(ts, tie), 1, lambda p: change_exprs(p, cols), strategy, block_rows)


def change_rate_pct(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "ts",
                    tie: Sequence[str] | None = None, strategy: str | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """``<col>_change_rate_pct`` = f / previous f - 1 with f the forward-filled series."""
    plan = plan_series(df, keys, _order(ts, tie), 1, strategy, block_rows)
    filled = {c: f"__ff_{c}" for c in cols}
    plan.with_columns({filled[c]: e for c, e in plan.ffill(cols).items()})
    plan.helpers += list(filled.values())
    plan.with_columns(pct_from_filled(plan, filled))
    return plan.finish()


def rolling(df: DataFrame, cols: Sequence[str], rows: int = 24, stats: Sequence[str] = ("mean", "std", "min", "max"),
            keys: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] | None = None,
            strategy: str | None = None, block_rows: int | None = None, suffix: str | None = None) -> DataFrame:
    """Statistics over the last ``rows`` rows (current included); NULLs skipped, min_periods=1. Linear in the rows, whatever the frame."""
    if floating(df, cols) and int(rows) > 0:
        sfx = suffix or ROLL_SUFFIX.get(rows, f"{rows}r")
        spec = SL.Spec(frames=((int(rows), tuple(stats), sfx),))
        out = walked_series(df, SL.Pass(list(keys), list(cols), spec), _order(ts, tie), spec.names(cols), strategy, block_rows)
        return out.withColumns({n: F.col(n).cast("long") for n in spec.names(cols) if n.endswith(f"_rolling_count_{sfx}")})
    return apply_series(df, keys, _order(ts, tie), rows - 1,
                        lambda p: rolling_exprs(p, cols, rows, stats, suffix), strategy, block_rows)


def rolling_time(df: DataFrame, cols: Sequence[str], hours: int = 24,
                 stats: Sequence[str] = ("mean", "std", "min", "max"), keys: Sequence[str] = (),
                 ts: str = "ts", strategy: str | None = None, bucket_hours: int | None = None) -> DataFrame:
    """Statistics over the true time range (ts - hours, ts].

    ``strategy="blocked"`` partitions by (keys, time bucket) and copies the last
    ``hours`` of each bucket into the next one, so no task holds a whole series.
    """
    span = int(hours) * 3_600_000_000
    sfx = f"{hours}h_time"
    t = "__t_us"
    d = df.withColumn(t, order_number(df, ts))
    if choose_strategy(df, strategy) == "blocked":
        bucket = int(bucket_hours or max(hours * 8, 24)) * 3_600_000_000
        if bucket < span:
            raise ValueError("bucket_hours must be at least hours")
        home = F.floor(F.col(t) / F.lit(bucket)).cast("long")
        nxt = F.when(F.col(t) - home * F.lit(bucket) >= F.lit(bucket - span), F.array(home, home + 1)) \
            .otherwise(F.array(home))
        d = d.withColumn("__home", home).withColumn("__tb", F.explode(nxt))
        w = Window.partitionBy(*keys, "__tb").orderBy(t).rangeBetween(-(span - 1), 0)
        out = d.withColumns({f"{c}_rolling_{s}_{sfx}": ROLL_STATS[s](c).over(w) for c in cols for s in stats})
        return out.filter(F.col("__tb").eqNullSafe(F.col("__home"))).drop(t, "__tb", "__home")
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-(span - 1), 0)
    return d.withColumns({f"{c}_rolling_{s}_{sfx}": ROLL_STATS[s](c).over(w) for c in cols for s in stats}).drop(t)


# --- 48-50: fills ------------------------------------------------------------------

def ffill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "ts",
          tie: Sequence[str] | None = None, strategy: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Replace NULL by the last non-NULL value before it in the series."""
    return apply_series(df, keys, _order(ts, tie), 0, lambda p: p.ffill(cols), strategy, block_rows)


def fill_missing(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "ts",
                 tie: Sequence[str] | None = None, causal: bool = False, strategy: str | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """Forward fill, then backward fill, then the series mean.

    After a forward fill only leading NULLs remain, so the backward fill equals
    the first non-NULL value of the series, and the mean can only matter for an
    all-NULL series, where it is NULL too. ``causal=True`` skips the backward
    (future-reading) step.
    """
    def build(p: SeriesPlan) -> dict[str, Column]:
        ff = p.ffill(cols)
        if causal:
            return ff
        first = p.series_first(cols)
        return {c: F.coalesce(ff[c], first[c]) for c in cols}

    return apply_series(df, keys, _order(ts, tie), 0, build, strategy, block_rows)


def fill_mode(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), default: str = "Unknown") -> DataFrame:
    """Text columns: NULL -> most frequent value (ties: smallest), none -> ``default``.

    Two steps, so that no buffer holds the distinct values of a key: counts per (key, column,
    value), combined before the shuffle, then the best of them per key. One row per key
    group is joined back (broadcast when there are no keys: one row).
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    counts = (df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.i", "__p.v").where("v IS NOT NULL")
              .groupBy(*keys, "i", "v").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(*keys).agg(*[
        F.min(F.when(F.col("i") == i, F.struct((-F.col("n")).alias("n"), "v"))).getField("v").alias(f"__mode_{c}")
        for i, c in enumerate(cols)])
    joined = join_null_safe(df, best, list(keys), "left") if keys else attach_row(df, best)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__mode_{c}"), F.lit(default)) for c in cols}) \
        .drop(*[f"__mode_{c}" for c in cols])


# --- 51: head/tail trend ------------------------------------------------------------

def head_tail_trend(df: DataFrame, value: str = "aqi", keys: Sequence[str] = (), ts: str = "ts",
                    tie: Sequence[str] | None = None, n: int = 10, band: float = 5.0,
                    strategy: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Mean of the last n rows minus mean of the first n; 'improving' / 'worsening' / 'stable'.

    Series with fewer than 2 rows give no row. Uses one row number (plain: one
    window; blocked: the exact distributed row number), a count per series and one aggregate.
    """
    keys = list(keys)
    order = _order(ts, tie)
    plan = plan_series(df.select(*keys, *order, value), keys, order, 0, strategy, block_rows)
    if plan.blocked:
        d = plan.finish(plan.df.withColumn("__pos", F.col("__rn")))
    else:
        d = plan.df.withColumn("__pos", F.row_number().over(plan.window))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cnt"))  # combined before its shuffle
    d = join_null_safe(d, counts, keys) if keys else attach_row(d, counts)
    g = d.groupBy(*keys)
    v = F.col(value)
    res = g.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.avg(F.when(F.col("__pos") > F.col("__cnt") - n, v)).alias("recent_mean"),
        F.avg(F.when(F.col("__pos") <= n, v)).alias("older_mean"),
    ).filter(F.col("n_records") >= 2)
    trend = F.col("recent_mean") - F.col("older_mean")
    return res.withColumns({
        "trend": trend,
        "trend_label": F.when(trend < -band, "improving").when(trend > band, "worsening").otherwise("stable"),
    })
