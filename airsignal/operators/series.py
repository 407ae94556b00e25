"""Per-series window planning.

A *series* is the rows of one location ordered by time. Window features over a
series (lags, row-count rolling frames, forward fill) are normally a single
``Window.partitionBy(keys).orderBy(ts)`` — one Exchange on the keys, one sort.

That plan puts a whole location in one task. When one location can hold a large
share of all rows (a hot key), the ``blocked`` strategy is used instead:

1. an exact row number inside the series is derived without sorting the series
   in one task: per-(key, time chunk) counts (map-side combined), a two-level
   prefix sum over the small count tables, and a row number inside each chunk;
2. rows are cut into blocks of ``block_rows`` consecutive rows; the last
   ``lookback`` rows of each block are copied into the next block (a halo);
3. the window runs over ``partitionBy(keys + block)``; halo rows are dropped.

Frames that look back a bounded number of rows give exactly the same values as
the plain plan. Unbounded look-back (forward fill) adds a carry per block, taken
from a block-level table (one row per block) by a window and an equi-join.

Both plans give the same rows, NULL keys and NULL times included (a NULL time is
the first of its series; NULL keys are one series). No job sizes the input: the
caller chooses with ``strategy``, or once for a session with
``airsignal.series.strategy`` (default ``plain``); set ``blocked`` where a
location can outgrow a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RN = "__rn"          # row number inside the series (1-based)
BLK = "__blk"        # block number
HALO = "__halo"      # row copied from the previous block
CHUNK = "__c1"

DEFAULT_BLOCK_ROWS = 2_000_000
DEFAULT_CHUNK_SECONDS = 60
GROUP_CHUNKS = 1024


def quote(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        return int(df.sparkSession.conf.get(key, str(default)))
    except Exception:  # noqa: BLE001 - conf missing on a remote session
        return default


def order_number(df: DataFrame, c: str) -> Column:
    """A numeric, order-preserving image of column ``c`` (micros for timestamps)."""
    t = dict(df.dtypes)[c]
    if t.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if t == "date":
        return F.unix_date(F.col(c)).cast("long") * F.lit(86_400_000_000)
    return F.col(c).cast("long")


def choose_strategy(df: DataFrame, strategy: str | None) -> str:
    """``plain`` or ``blocked``: the caller's choice, else the session's (``airsignal.series.strategy``), else plain."""
    strategy = strategy or df.sparkSession.conf.get("airsignal.series.strategy", "plain")
    if strategy not in ("plain", "blocked"):
        raise ValueError(f"unknown series strategy {strategy!r}")
    return strategy


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the left side's key columns are kept."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def series_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      chunk_seconds: int = DEFAULT_CHUNK_SECONDS, chunk_width: int | None = None) -> DataFrame:
    """Adds ``__rn``: exact 1-based position of each row in its series.

    No task sorts a whole series: counts per (key, chunk) are combined map-side,
    the prefix sums run over count tables (one row per chunk, grouped by 1024
    chunks), and only one chunk of one key is ever sorted together.
    """
    keys = list(keys)
    lead = order[0]
    if chunk_width is not None:
        width = max(int(chunk_width), 1)
    elif dict(df.dtypes)[lead].startswith(("timestamp", "date")):
        width = int(chunk_seconds) * 1_000_000
    else:
        width = max(int(chunk_seconds), 1)
    rows = df.withColumn(CHUNK, F.floor(order_number(df, lead) / F.lit(width)).cast("long"))
    c2 = F.floor(F.col(CHUNK) / F.lit(GROUP_CHUNKS)).cast("long")
    counts1 = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n1")).withColumn("__c2", c2)
    counts2 = counts1.groupBy(*keys, "__c2").agg(F.sum("__n1").alias("__n2"))
    w2 = Window.partitionBy(*keys).orderBy("__c2").rowsBetween(Window.unboundedPreceding, 0)
    off2 = counts2.withColumn("__o2", F.sum("__n2").over(w2) - F.col("__n2")).drop("__n2")
    w1 = Window.partitionBy(*keys, "__c2").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    off1 = (join_null_safe(counts1, off2, [*keys, "__c2"])
            .withColumn("__o1", F.col("__o2") + F.sum("__n1").over(w1) - F.col("__n1"))
            .select(*keys, CHUNK, "__o1"))
    wr = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (join_null_safe(rows, off1, [*keys, CHUNK])
            .withColumn(RN, F.col("__o1") + F.row_number().over(wr))
            .drop("__o1", CHUNK))


@dataclass
class SeriesPlan:
    """Rows prepared for per-series windows.

    ``window``: ordered window inside a series (or inside a block of it);
    ``whole``: unordered window over the whole partition (plain plan only);
    ``finish()`` removes halo rows and helper columns.
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    blocked: bool
    window: WindowSpec
    helpers: list[str] = field(default_factory=list)

    def part_keys(self) -> list[str]:
        return [*self.keys, BLK] if self.blocked else list(self.keys)

    def over(self, frame: str = "") -> str:
        """SQL text of ``window`` plus an optional frame, e.g. ``ROWS BETWEEN 23 PRECEDING AND CURRENT ROW``.

        Wide feature blocks build hundreds of window expressions; one ``F.expr`` per
        expression is one JVM call, where the Column API makes several per expression.
        """
        order = [RN] if self.blocked else self.order
        parts = [f"PARTITION BY {', '.join(map(quote, self.part_keys()))}"] if self.part_keys() else []
        parts.append(f"ORDER BY {', '.join(map(quote, order))}")
        if frame:
            parts.append(frame)
        return f"OVER ({' '.join(parts)})"

    def finish(self, df: DataFrame | None = None) -> DataFrame:
        d = self.df if df is None else df
        if self.blocked:
            d = d.filter(~F.col(HALO))
        return d.drop(*[h for h in self.helpers if h in d.columns])

    def with_columns(self, cols: dict[str, Column]) -> "SeriesPlan":
        self.df = self.df.withColumns(cols)
        return self

    # --- unbounded look-back -------------------------------------------------
    def ffill(self, cols: Sequence[str]) -> dict[str, Column]:
        """Column expressions: last non-NULL value at or before each row."""
        last = {c: f"last({quote(c)}, true) {self.over(RUNNING)}" for c in cols}
        if not self.blocked:
            return {c: F.expr(e) for c, e in last.items()}
        # carry of each block = last non-NULL value of all earlier blocks
        real = self.df.filter(~F.col(HALO))
        last_in_block = real.groupBy(*self.keys, BLK).agg(*[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"__bl_{c}") for c in cols])
        before = Window.partitionBy(*self.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
        carry = last_in_block.select(*self.keys, BLK, *[
            F.last(f"__bl_{c}", ignorenulls=True).over(before).alias(f"__cy_{c}") for c in cols])
        self.df = join_null_safe(self.df, carry, [*self.keys, BLK], "left")
        self.helpers += [f"__cy_{c}" for c in cols]
        return {c: F.expr(f"coalesce({last[c]}, {quote('__cy_' + c)})") for c in cols}

    def series_first(self, cols: Sequence[str]) -> dict[str, Column]:
        """Column expressions: first non-NULL value of the whole series."""
        if not self.blocked:
            return {c: F.expr(f"first({quote(c)}, true) {self.over(WHOLE)}") for c in cols}
        real = self.df.filter(~F.col(HALO))
        firsts = real.groupBy(*self.keys).agg(*[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"__sf_{c}") for c in cols])
        self.df = join_null_safe(self.df, firsts, self.keys, "left") if self.keys else attach_row(self.df, firsts)
        self.helpers += [f"__sf_{c}" for c in cols]
        return {c: F.col(f"__sf_{c}") for c in cols}


def plan_series(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], lookback: int,
                strategy: str | None = None, block_rows: int | None = None) -> SeriesPlan:
    """Prepare ``df`` for windows that look back at most ``lookback`` rows."""
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    strategy = choose_strategy(df, strategy)
    if strategy == "plain":
        w = Window.partitionBy(*keys).orderBy(*order)
        return SeriesPlan(df, keys, order, False, w)
    # a halo comes from one block only, so a block is longer than the look-back
    b = max(int(block_rows or _conf_int(df, "airsignal.series.blockRows", DEFAULT_BLOCK_ROWS)), int(lookback) + 1)
    ranked = series_row_number(df, keys, order)
    pos = (F.col(RN) - 1) % F.lit(b)
    blk = F.floor((F.col(RN) - 1) / F.lit(b)).cast("long")
    targets = F.when(pos >= F.lit(b - lookback), F.array(blk, blk + 1)).otherwise(F.array(blk)) \
        if lookback > 0 else F.array(blk)
    with_halo = (ranked.withColumn("__home", blk)
                 .withColumn(BLK, F.explode(targets))
                 .withColumn(HALO, F.col(BLK) != F.col("__home"))
                 .drop("__home"))
    w = Window.partitionBy(*keys, BLK).orderBy(RN)
    return SeriesPlan(with_halo, keys, order, True, w, helpers=[RN, BLK, HALO])


def apply_series(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], lookback: int,
                 build: Callable[[SeriesPlan], dict[str, Column]], strategy: str | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """One-step helper: ``build(plan)`` returns the new columns."""
    plan = plan_series(df, keys, order, lookback, strategy, block_rows)
    cols = build(plan)
    return plan.finish(plan.df.withColumns(cols))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.

    A broadcast hash join on a constant key: the right side is one row by
    construction (an aggregate without grouping keys), so broadcasting it is
    bounded, and the plan has no cartesian product.
    """
    return (df.withColumn("__one", F.lit(0))
            .join(F.broadcast(one_row.withColumn("__one", F.lit(0))), "__one", "inner")
            .drop("__one"))
