"""Keyed state of series between micro-batches: features of new readings without reading the past again.

The state of a series holds its latest ``KEEP`` rows (times and values), and for each column the last value before them with its time. That is
what any row within reach depends on: frames and lags count at most ``look_back`` rows, and relative changes need the last value
before. New rows are merged into the kept ones by time; features are made for the first new row and all after it, so a late row within reach corrects
the rows after it. Rows that come later than the state reaches are marked ``LATE``: they are recomputed from the reading store, and the
state learns what it needs of them.

With an expiry, a timer runs from a series' latest batch on (processing time). When it fires the rows are let go; the last values stay, and
the next rows of the series are recomputed from the store until the state reaches back far enough again.

The processor, called once per series and batch, only keeps the state: it returns one row per series, with the readings that features are made of
as packed arrays. ``unpacked`` makes the features of many series at once, in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from airsignal.operators import sliding as SL

# names without a leading underscore: rows reach the processor as named tuples
KEY, TIME, KIND, NEW = "series_key", "time_us", "row_kind", "row_new"
FEATURES, LATE = 1, 2
# what the processor returns of a series: leading rows that only count in frames; its rows; the last values before them
HALO, ROWS = "halo_rows", ["times", "x", "ok", "fresh", "last", "last_ok"]
PACKED = StructType([StructField(KEY, StringType()), StructField(KIND, IntegerType()), StructField(HALO, IntegerType()), *[StructField(c, BinaryType()) for c in ROWS]])
#: Rows whose features are made at once (a series is never cut).
TOGETHER = 20_000
#: Rows kept of a series: the longest frame, and as many rows that a late one may come behind.
KEEP = 2 * (SL.DERIVED.look_back + 1)
STATE = "times binary, x binary, ok binary, last binary, last_ok binary, last_time binary, more boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the RocksDB store; queries started inside use it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Held:
    """The state of one series: rows in the order of time, and the last values before them."""

    def __init__(self, width: int) -> None:
        self.times, self.x, self.ok = np.zeros(0, np.int64), np.zeros((0, width)), np.zeros((0, width), bool)
        self.last, self.last_ok, self.last_time = np.zeros(width), np.zeros(width, bool), np.full(width, np.iinfo(np.int64).min)
        self.more = False  # rows before the kept ones exist

    @classmethod
    def unpack(cls, packed: tuple, width: int) -> "Held":
        out = cls(width)
        times, x, ok, last, last_ok, last_time, out.more = packed
        out.times = np.frombuffer(times, np.int64)
        out.x, out.ok = np.frombuffer(x, float).reshape(-1, width), np.frombuffer(ok, bool).reshape(-1, width)
        out.last, out.last_ok, out.last_time = np.frombuffer(last, float).copy(), np.frombuffer(last_ok, bool).copy(), np.frombuffer(last_time, np.int64).copy()
        return out

    def packed(self) -> tuple:
        return (self.times.tobytes(), self.x.tobytes(), self.ok.tobytes(), self.last.tobytes(), self.last_ok.tobytes(), self.last_time.tobytes(), bool(self.more))

    def passed(self, times: np.ndarray, x: np.ndarray, ok: np.ndarray) -> None:
        """Rows that stand before the kept ones: their values count as last ones where they are the latest."""
        for i in range(len(times)):
            newer = ok[i] & (times[i] >= self.last_time)
            self.last[newer], self.last_time[newer] = x[i][newer], times[i]
            self.last_ok |= newer
        self.more = self.more or len(times) > 0

    def add(self, times: np.ndarray, x: np.ndarray, ok: np.ndarray, keep: int, look_back: int) -> tuple[int | None, np.ndarray, np.ndarray, np.ndarray]:
        """Merge rows (in order, one per time); (place of the first one, or None where the state does not reach so far back; all rows)."""
        beyond = self.more & (times < self.times[0] if len(self.times) else self.last_time.max(initial=np.iinfo(np.int64).min) >= times)
        beyond = np.broadcast_to(beyond, times.shape)
        if beyond.any():
            self.passed(times[beyond], x[beyond], ok[beyond])
        inside = ~beyond
        stay = ~np.isin(self.times, times[inside])
        all_t = np.append(self.times[stay], times[inside])
        order = np.argsort(all_t, kind="stable")
        self.times = all_t[order]
        self.x, self.ok = np.vstack([self.x[stay], x[inside]])[order], np.vstack([self.ok[stay], ok[inside]])[order]
        rows = self.times, self.x, self.ok
        first = int(np.searchsorted(self.times, times[0])) if not beyond.any() else None
        if first is not None and self.more and first < look_back:
            first = None
        return first, *rows

    def trim(self, keep: int) -> None:
        cut = len(self.times) - keep
        if cut > 0:
            self.passed(self.times[:cut], self.x[:cut], self.ok[:cut])
            self.times, self.x, self.ok = self.times[cut:], self.x[cut:], self.ok[cut:]


def in_order(times: np.ndarray, x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by time, of equal times the largest (absent values are the smallest, columns compared in order)."""
    value = np.where(ok, x, -np.inf)
    order = np.lexsort([*[k for j in reversed(range(x.shape[1])) for k in (value[:, j], ok[:, j])], times])
    last = np.append(times[order][1:] != times[order][:-1], True)
    at = order[last]
    return times[at], x[at], ok[at]


class SeriesProcessor(StatefulProcessor):
    def __init__(self, series: Sequence[str], expire_ms: int | None, keep: int = KEEP) -> None:
        self.series, self.expire_ms, self.keep = list(series), expire_ms, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows, timerValues):
        rows = list(rows)
        width, look_back = len(self.series), SL.DERIVED.look_back
        packed = self.state.get()
        held = Held(width) if packed is None else Held.unpack(packed, width)
        at = [rows[0].__fields__.index(c) for c in (TIME, *self.series)]
        times = np.array([r[at[0]] for r in rows], np.int64)
        values = np.array([[r[j] for j in at[1:]] for r in rows], dtype=float).reshape(len(rows), width)  # absent: NaN
        t, x, ok = in_order(times, np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(values))
        lead, known = held.last.copy(), held.last_ok.copy()
        first, times, kept, have = held.add(t, x, ok, self.keep, look_back)
        if first is None:  # readings only: their features come from the store
            out = self.row(key, LATE, 0, t, x, ok, np.ones(len(t), bool), lead, known)
        else:
            begin = max(first - look_back, 0)
            if begin:  # rows that no frame reaches are left out, but their last values count
                last = np.where(have[:begin], np.arange(begin)[:, None], -1).max(axis=0)
                lead, known = np.where(last >= 0, kept[np.maximum(last, 0), np.arange(width)], lead), known | (last >= 0)
            out = self.row(key, FEATURES, first - begin, times[begin:], kept[begin:], have[begin:], np.isin(times[begin:], t), lead, known)
        held.trim(self.keep)
        self.state.update(held.packed())
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield out

    def row(self, key, kind: int, halo: int, *arrays: np.ndarray) -> Row:
        return Row(**{KEY: key[0], KIND: kind, HALO: halo, **{c: v.tobytes() for c, v in zip(ROWS, arrays)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = Held.unpack(self.state.get(), len(self.series))
        held.trim(0)
        self.state.update(held.packed())
        return iter([])

    def close(self) -> None:
        pass


def unpacked(batch: pa.RecordBatch, series: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    """The processor's rows of many series -> readings with their features, without the halo. ``LATE`` readings have none."""
    width = len(series)
    flat = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
    times, x, ok, fresh = flat("times", np.int64), flat("x", float).reshape(-1, width), flat("ok", bool).reshape(-1, width), flat("fresh", bool)
    last, known = flat("last", float).reshape(-1, width), flat("last_ok", bool).reshape(-1, width)
    n = pc.binary_length(batch.column("times")).to_numpy() // 8
    of = np.repeat(np.arange(batch.num_rows), n)
    start = np.repeat(np.cumsum(n) - n, n)
    keep = np.arange(len(of)) - start >= batch.column(HALO).to_numpy()[of]
    kind = batch.column(KIND).to_numpy()[of]
    values = {c: (x[:, j], ok[:, j]) for j, c in enumerate(series)}
    made = SL.derived_arrays(values, start, SL.DERIVED, {c: (last[of, j], known[of, j]) for j, c in enumerate(series)})
    made = {c: (v, there & (kind == FEATURES) & ~np.isnan(v)) for c, (v, there) in made.items()}
    out = {KEY: batch.column(KEY).take(pa.array(of[keep])), TIME: pa.array(times[keep]), KIND: pa.array(kind[keep], pa.int32()), NEW: pa.array(fresh[keep]),
           **{c: SL.arrow_column((v[keep], there[keep])) for c, (v, there) in (values | made).items()}}
    return pa.RecordBatch.from_arrays([out[c] for c in schema.names], schema=schema)


def _unpack(series: Sequence[str], out: StructType):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.cumsum(pc.binary_length(batch.column("times")).to_numpy() // 8)
            begin = 0
            while begin < batch.num_rows:
                before = rows[begin - 1] if begin else 0
                end = max(int(np.searchsorted(rows, before + TOGETHER, side="right")), begin + 1)
                yield unpacked(batch.slice(begin, end - begin), series, schema)
                begin = end

    return run


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a time as a number, without any time zone for local times."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def with_time(out: DataFrame, ts: str, like: DataFrame) -> DataFrame:
    """The rows of ``stateful`` with their time column back."""
    if dict(like.dtypes)[ts] == "timestamp_ntz":
        t = F.expr(f"timestampadd(MICROSECOND, {TIME}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    else:
        t = F.timestamp_micros(F.col(TIME))
    return out.withColumn(ts, t).drop(TIME)


def milliseconds(spark: SparkSession, interval: str) -> int:
    return int(spark.range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00' + INTERVAL {interval}) - unix_millis(TIMESTAMP'1970-01-01 00:00:00') AS BIGINT)")).first()[0])


def stateful(readings: DataFrame, keys: Sequence[str], ts: str, series: Sequence[str], expire: str | None = None, keep: int = KEEP) -> DataFrame:
    """Streaming readings -> rows to write: new readings with their features, rows whose features have changed, and ``LATE`` readings."""
    # keys as one text: absent keys are one series, and come back with their types
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    rows = readings.filter(F.col(ts).isNotNull()).select(key.alias(KEY), _micros(readings, ts).alias(TIME), *[F.col(c).cast("double").alias(c) for c in series])
    schema = StructType([StructField(KEY, StringType()), StructField(TIME, LongType()), StructField(KIND, IntegerType()), StructField(NEW, BooleanType()),
                         *[StructField(c, DoubleType()) for c in [*series, *SL.DERIVED.names(series)]]])
    expire_ms = None if expire is None else milliseconds(readings.sparkSession, expire)
    out = rows.groupBy(KEY).transformWithState(SeriesProcessor(series, expire_ms, keep), PACKED, "Update",
                                               "None" if expire is None else "ProcessingTime").mapInArrow(_unpack(list(series), schema), schema)
    back = F.from_json(KEY, StructType([readings.schema[k] for k in keys]))
    return out.select(*[back.getField(k).alias(k) for k in keys], *[c for c in out.columns if c != KEY])
