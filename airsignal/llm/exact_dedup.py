"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when they are identical after each run of white space (space, \\t, \\n, \\v, \\f, \\r) became one
space. The key of a text is a 64-bit hash of that normal form.

* Entries: (row, doc_id, key, SHA-256) of every row, written to shared storage; no text.
* Directory: starts as one bucket. While a bucket holds more than ``bucket_keys`` distinct keys, it is split by one more
  leading bit of the key; a split beyond the directory's depth doubles the directory. It is worked out on a histogram of the
  leading ``DEPTH`` bits (at most 2**DEPTH numbers) and written beside the entries. A bucket that
  cannot be split further (equal leading bits) stays overfull and only grows its chains.
* Owner tasks: each bucket is a range of keys and has one owner. Owners read the texts of keys that occur more than once,
  chain the different texts of a key, comparing bytes, and write the chains to the index. Equal texts are
  combined before they are sent, so a group of copies reaches its owner once per batch and not once per row.
* The smallest doc_id and the size of each class come from the entries by a plain pre-aggregated grouping.

Results: null counts as empty, all empty texts are one class; texts of white space alone equal one space. A null doc_id
is kept only if its class has no other. Rows that repeat doc_id and text are copies like any other and one of them stays.
An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import saved, shuffle_partitions, unused

#: Distinct keys that a bucket holds before it is split, and the leading bits that can be used for splits.
BUCKET_KEYS = 2_000
DEPTH = 16
#: Runs that change when they become one space; single spaces are left alone.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def entries(docs: DataFrame) -> DataFrame:
    """row, doc_id, key and sha of every row."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("norm"))
    return norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def directory(cells: np.ndarray, counts: np.ndarray, bucket_keys: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """First cell and local depth of each bucket, and the directory's global depth, from the keys counted per cell of ``depth`` leading bits."""
    full = np.zeros((1 << depth) + 1, np.int64)
    full[cells + 1] = counts
    upto = np.cumsum(full)
    buckets, first, local, deepest = [(0, 0)], [], [], 0
    while buckets:
        at, d = buckets.pop()
        width = 1 << (depth - d)
        if upto[at + width] - upto[at] > bucket_keys and d < depth:
            buckets += [(at + width // 2, d + 1), (at, d + 1)]
            deepest = max(deepest, d + 1)
        else:
            first.append(at)
            local.append(d)
    return np.array(first), np.array(local), deepest


def build_index(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, directory, chains): the tables of the index, all on shared storage.

    directory has a row per bucket: bucket, first_cell, local_depth, global_depth. chains has a row per
    different text of each repeated key: bucket, key, chain, sha.
    """
    spark = docs.sparkSession
    table = saved(entries(docs), "entries")
    keys = saved(table.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "keys")
    cell = F.shiftrightunsigned("key", 64 - DEPTH).cast("int")
    found = keys.groupBy(cell.alias("cell")).count().collect()  # at most 2**DEPTH rows
    first, local, deepest = directory(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), bucket_keys)
    listed = saved(spark.createDataFrame([(k, int(a), int(d), deepest) for k, (a, d) in enumerate(zip(first, local, strict=True))],
                                         "bucket int, first_cell int, local_depth int, global_depth int"), "directory")

    repeated = keys.where("rows > 1").select("key")
    wanted = table.join(repeated, "key").select("doc_id").distinct()
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("d")
             .join(wanted.alias("w").hint("shuffle_hash"), F.expr("d.doc_id <=> w.doc_id"), "left_semi")
             .select(normalised(F.col("text")).alias("norm")).select(F.xxhash64("norm").alias("key"), "norm"))
    starts = spark.sparkContext.broadcast(first)  # a number per bucket, at most 2**DEPTH

    def combine(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["key", "norm"]).aggregate([([], "count_all")])
            cells = (t.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - DEPTH)).astype(np.int64)
            bucket = pa.array((np.searchsorted(starts.value, cells, "right") - 1).astype(np.int32))
            yield from pa.Table.from_arrays([bucket, t.column("key"), t.column("norm")], names=["bucket", "key", "norm"]).to_batches()

    def own(batches):
        import hashlib

        key, chain = None, {}
        for batch in batches:
            out = []
            for bucket, k, norm in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "norm")), strict=True):
                if k != key:
                    key, chain = k, {}
                if norm not in chain:  # a dict finds by hash and compares the whole text
                    sha = hashlib.sha256(norm.encode()).hexdigest()
                    if sha in chain.values():
                        raise ValueError(f"two texts with key {k} share SHA-256 {sha}")
                    out.append((bucket, k, len(chain), sha))
                    chain[norm] = sha
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)],
                                                 names=["bucket", "key", "chain", "sha"])

    chains = (texts.mapInArrow(combine, "bucket int, key long, norm string")
              .repartition(shuffle_partitions(docs), "bucket").sortWithinPartitions("bucket", "key")
              .mapInArrow(own, "bucket int, key long, chain int, sha string"))
    return table, listed, saved(chains, "chains")


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, copies included."""
    table, _, chains = build_index(docs, bucket_keys)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = saved(table.join(chains.select("key", "sha"), ["key", "sha"], "left_semi")
                    .groupBy("key", "sha").agg(smallest.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("key", "sha", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "n"), "classes")
    joined = table.join(classes, ["key", "sha"], "left")
    alone = F.col("n").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
                         F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                         (alone | (F.col("row") == F.col("first_row"))).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    found = saved(exact_duplicates(docs, bucket_keys), "exact")
    # dropped rows are the fewer, and the smaller side of the join
    gone = found.where("not kept and not (doc_id <=> keep_id)").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(normalised(F.col("d.text").cast("string")), 256)
    left = docs.alias("d").join(gone.alias("g").hint("shuffle_hash"), (F.expr("cast(d.doc_id as bigint) <=> g.doc_id")) & (sha == F.col("g.text_sha256")), "left_anti")
    if not found.where("not kept and doc_id <=> keep_id").isEmpty():  # rows that repeat both doc_id and text
        key, shas = unused("row_sha", docs), F.sha2(normalised(F.col("text").cast("string")), 256)
        left = left.withColumn(key, shas).dropDuplicates(["doc_id", key]).drop(key)
    return left


def _oracle() -> str:
    return r"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, n) AS place FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM k"""


ORACLE = _oracle()
