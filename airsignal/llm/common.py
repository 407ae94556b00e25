"""Shared helpers: reading tables, scratch tables on shared storage, and text buffers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsignal.session import scratch_path

#: White space of every contract that names it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text that a vectorised step handles at once; longer single rows are cut inside the step.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost executor never
    repeats the work above it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written by ``saved`` inside of ``scratch``, innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that ``saved`` has written inside, when all is done; the list yielded names them, and what is taken out of it stays."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        for path in _WRITTEN.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` lacks, whatever the case."""
    have, out = {c.lower() for c in df.columns}, f"__{name}"
    while out in have:
        out += "_"
    return out


def partitions_for(rows: int, per_partition: int, at_least: int) -> int:
    return max(at_least, -(-rows // per_partition))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of the column's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def first_ids_per(ids: DataFrame, max_rows: int | dict, label: str, all_rows: int | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, label): at most ``max_rows`` rows of every label (a number, or one by label) in the order of a hash of doc_id; and how many doc_ids each label has.

    With more labels than ``all_rows`` / ``max_rows`` each gets an equal part of ``all_rows``, 20 at least. A repeated doc_id counts once, with its smallest label. Large labels are thinned by the hash before they are
    ranked, so a rank's task reads little more than ``max_rows`` rows whatever the size of the table.
    """
    own = ids.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    counts = {r[0]: r[1] for r in own.groupBy(label).count().collect()}  # a row per label
    if all_rows is not None:
        max_rows = min(max_rows, max(20, all_rows // max(1, len(counts))))
    most = {v: max_rows[v] if isinstance(max_rows, dict) else max_rows for v in counts}
    place = F.xxhash64("doc_id")
    few = {v: m + 8 * int(m ** 0.5) + 64 for v, m in most.items()}  # so many are expected below the cut, hence the rows wanted at least
    cuts = {v: int(few[v] / n * 2.0 ** 64) - (1 << 63) for v, n in counts.items() if n > few[v]}
    if cuts:
        at = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        own = own.where(F.coalesce(place <= F.element_at(at, F.col(label)), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, "doc_id"))
    limit = F.lit(max_rows) if not isinstance(max_rows, dict) else F.element_at(F.create_map(*[F.lit(x) for pair in max_rows.items() for x in pair]), F.col(label))
    return own.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank"), counts


#: Texts of a label all of whose texts are too long: so many of the shortest, cut.
LONG_ROWS = 20


def labelled_sample(docs: DataFrame, known: DataFrame, label: str, per_label: int | dict, max_chars: int, all_rows: int | None = None) -> tuple[list, dict]:
    """((doc_id, text, label) ordered by doc_id; rows of each label): at most ``per_label`` texts of every label, in the order of a hash of doc_id.

    ``known`` has doc_id, the label and the text's characters (``chars``, not null), without texts: only these few numbers are joined and ranked. Texts over ``max_chars``
    characters are left out before any is chosen, so every label keeps its share of the sample; a label with long texts only has ``LONG_ROWS`` of the shortest instead, their
    first ``max_chars`` characters. The ids chosen are broadcast, and one scan of ``docs`` fetches the texts. Of several texts or labels of one
    doc_id the smallest counts. What comes to the driver is bounded by the parameters and the number of labels.
    """
    own = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias(label), "chars").where(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.col("chars").isNotNull())
    own = saved(own, "labels")
    fits = F.col("chars") <= max_chars
    sizes = {r[0]: (r[1], r[2]) for r in own.groupBy(label).agg(F.count(F.lit(1)), F.count(F.when(fits, 1))).collect()}  # a row per label
    chosen, _ = first_ids_per(own.where(fits).select("doc_id", label), per_label, label, all_rows)
    long_only = [v for v, (_, short) in sizes.items() if not short]
    if long_only:
        rank = F.row_number().over(Window.partitionBy(label).orderBy("chars", F.xxhash64("doc_id"), "doc_id"))
        few = own.where(F.col(label).isin(long_only)).withColumn("__rank", rank).where(F.col("__rank") <= LONG_ROWS).select("doc_id", label)
        chosen = chosen.unionByName(few.groupBy("doc_id").agg(F.min(label).alias(label)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(text, 1, max_chars).alias("text"), (F.char_length(text) <= max_chars).alias("fits"))
    found = kept.join(F.broadcast(chosen), "doc_id").where(F.col("fits") | F.col(label).isin(long_only) if long_only else F.col("fits"))
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label))
    return sorted(found.collect(), key=lambda r: r.doc_id), {v: n for v, (n, _) in sizes.items()}


def with_chars(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label columns, chars) of the labelled documents: what ``labelled_sample`` takes; no text is shuffled. A null text has no characters."""
    chars = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), chars).join(labels, "doc_id")


# ---- inside tasks -------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(i, j) row ranges of at most ``limit`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def byte_pieces(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(bytes, offsets of all rows within them): whole rows, together about ``limit`` bytes.

    A longer row is cut alone, after white space where there is any, so where a text is cut does not depend on its neighbours.
    """
    for i, j in row_slices(offsets, limit):
        at, stop = int(offsets[i]), int(offsets[j])
        while at < stop:
            end = min(stop, at + limit) if j == i + 1 else stop
            if end < stop:
                gap = np.flatnonzero(IS_SPACE[data[max(at, end - 4096):end]])
                if len(gap):
                    end = max(at, end - 4096) + int(gap[-1]) + 1
            yield data[at:end], np.clip(offsets - at, 0, end - at)
            at = end


#: True at the bytes of SPACE_CLASS.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Growing tables of BASE**i and BASE**-i modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << int(n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, BASE_INV)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h


def range_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of symbols[start:end] for each pair, by one running polynomial sum over ``symbols``."""
    up, down = powers.upto(len(symbols) + 1)
    run = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start])


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (run of bytes not marked in ``space``); words never cross rows."""
    is_space = space[data]
    first = np.ones(len(data), bool)
    first[1:] = is_space[:-1]
    inner = offsets[1:-1]
    first[inner[inner < len(data)]] = True
    start = np.flatnonzero(first & ~is_space)
    last = np.ones(len(data), bool)
    last[:-1] = is_space[1:]
    last[inner[(inner > 0) & (inner <= len(data))] - 1] = True
    end = np.flatnonzero(last & ~is_space) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row
