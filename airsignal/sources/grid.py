"""Hourly spine and regular grid per location.

The spine of one key is ``explode(sequence(start, end, step))``: its size is
bounded by the time span / step, not by the data. ``regularize`` left-joins the
readings to it on (keys, ts), so a hot location is spread over its hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Steps of a spine in one array.
BLOCK_STEPS = 1024


def _interval(step_seconds: int) -> Column:
    return F.expr(f"INTERVAL '{int(step_seconds)}' SECOND")


def hourly_spine(df: DataFrame, start: str | Column, end: str | Column, step_seconds: int = 3600,
                 keep: Sequence[str] = (), name: str = "ts") -> DataFrame:
    """One row per step from ``start`` to ``end`` inclusive, for every row of ``df``."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    # in two levels, so that no array holds a whole spine
    blocks = df.select(*keep, e.alias("__e"), F.explode(F.sequence(s, e, _interval(step_seconds * BLOCK_STEPS))).alias("__s"))
    last = F.least(F.col("__e"), F.col("__s") + _interval(step_seconds * (BLOCK_STEPS - 1)))
    return blocks.select(*keep, F.explode(F.sequence(F.col("__s"), last, _interval(step_seconds))).alias(name))


def regularize(df: DataFrame, keys: Sequence[str], ts: str = "ts", step_seconds: int = 3600,
               cols: Sequence[str] | None = None) -> DataFrame:
    """Readings on a regular grid per key (min..max of that key); missing steps have NULL measures.

    Readings are truncated to the step first and averaged when several fall
    into one step (partial aggregation), so each grid point has at most one row.
    """
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in (*keys, ts)]
    step = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step_seconds) * step_seconds) \
        .cast("timestamp_ntz")
    snapped = df.select(*keys, step.alias(ts), *cols).groupBy(*keys, ts).agg(*[F.avg(c).alias(c) for c in cols])
    bounds = snapped.groupBy(*keys).agg(F.min(ts).alias("__start"), F.max(ts).alias("__end"))
    spine = hourly_spine(bounds, "__start", "__end", step_seconds, keep=keys, name=ts)
    return spine.join(snapped, [*keys, ts], "left")
