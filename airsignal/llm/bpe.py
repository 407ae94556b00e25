"""Byte-level BPE encoding and decoding by tree concatenation.

The vocabulary is a public ``tokenizers`` JSON file whose path is a parameter. Short texts are encoded
whole. A text over ``LONG_CHARS`` is cut in halves until each leaf is small; the leaves are rows of
their own, encoded in parallel by different tasks, and joined again as a tree:

* a cut between a printable ASCII character and ASCII white space, at an added token, or between two pretokens is a
  boundary of the pretokeniser whatever stands around it, so the leaves' ids are simply appended;
* a run that the pretokeniser does not split (base64, a line of one character, text without spaces) is cut anywhere.
  Its leaves are encoded by merges alone, and at each join a window of the last and first ids is
  decoded, encoded again and doubled until its first and last ids agree with those of both sides. Two ids that
  may stand next to each other do so whatever surrounds them, so agreement on both sides proves
  the joined ids equal to those of the whole run; a window that has grown to both sides whole is exact anyway.

Results: null and empty texts give no ids and an empty decoded text; repeated rows are encoded each;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts with more characters are spread over tasks.
LONG_CHARS = 1 << 15
#: Leaves of spread texts have at most about this many characters.
LEAF_CHARS = 1 << 14
#: Runs without a split of more bytes are halved before merging.
RUN_BYTES = 1 << 10
#: Ids on each side of a join in the first window.
WINDOW = 8
#: Fixed value: the pretokeniser's pattern of byte-level BPE vocabularies with ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_RUN = re.compile(r"[^\t\n\r ]{%d,}|\s{%d,}" % (RUN_BYTES, RUN_BYTES))
BOUNDARY = re.compile(r"(?<=[!-~])(?=[\t\n\r ])")


def vocabulary(path: str) -> dict:
    """Read a ``tokenizers`` JSON file: mergeable ranks by bytes and the added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("only byte-level BPE without prefix space and normaliser is supported")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + i)
    to_byte = {c: b for b, c in chars.items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return {"ranks": ranks, "added": added}


class Codec:
    """Encoder and decoder of one vocabulary inside a task."""

    def __init__(self, spec: dict) -> None:
        import tiktoken

        self.added = spec["added"]
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=spec["ranks"], special_tokens=self.added)
        self.run = self.encoding._core_bpe.encode_single_piece
        self.bytes_of = self.encoding.decode_bytes
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode(text, allowed_special="all", disallowed_special=()), np.uint32)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the run whose left part has ids ``a`` and whose right part has ids ``b``."""
        if not len(a) or not len(b):
            return np.concatenate([a, b])
        k = WINDOW
        while True:
            left, right = a[max(0, len(a) - k):], b[:k]
            whole_a, whole_b = len(left) == len(a), len(right) == len(b)
            ids = np.asarray(self.run(self.bytes_of([*left.tolist(), *right.tolist()])), np.uint32)
            if (whole_a or ids[0] == left[0]) and (whole_b or ids[-1] == right[-1]):
                return np.concatenate([a[:len(a) - len(left)], ids, b[len(right):]])
            k *= 2

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Join neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.uint32)

    def unsplit(self, run: bytes) -> np.ndarray:
        """Ids of a run that the pretokeniser leaves whole."""
        return self.tree([np.asarray(self.run(x), np.uint32) for x in halves(run, RUN_BYTES)])

    def pieces(self, text: str, limit: int):
        """(text, joins the piece before) in order; cuts are exact boundaries unless the piece joins."""
        for k, segment in enumerate(self.at_added.split(text) if self.at_added else [text]):
            if k % 2:
                yield segment, False, False
                continue
            at = 0
            for end in [*cuts(segment, limit), len(segment)]:
                part, at = segment[at:end], end
                if len(part) <= RUN_BYTES or not LONG_RUN.search(part):
                    if part:
                        yield part, False, False
                    continue
                yield from pretokens(part, limit)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= RUN_BYTES or not LONG_RUN.search(text):
            return self.plain(text)
        return self.collect((self.leaf(t, raw), joins) for t, joins, raw in self.pieces(text, LEAF_CHARS))

    def leaf(self, text: str, raw: bool) -> np.ndarray:
        return self.unsplit(text.encode()) if raw else self.plain(text)

    def collect(self, leaves) -> np.ndarray:
        """All ids of (ids, joins the leaf before) in order."""
        done, run = [], []
        for ids, joins in leaves:
            if not joins and run:
                done.append(self.tree(run))
                run = []
            run.append(ids)
        if run:
            done.append(self.tree(run))
        return np.concatenate(done) if done else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids.tolist()).decode("utf-8", errors="replace")


def halves(run, limit: int) -> list:
    """Cut in halves until no part is longer than ``limit``."""
    if len(run) <= limit:
        return [run]
    mid = len(run) // 2
    return halves(run[:mid], limit) + halves(run[mid:], limit)


def cuts(text: str, limit: int) -> list[int]:
    """Exact boundaries that cut ``text`` in halves until parts are at most ``limit`` long, where there are any."""
    out, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= limit:
            continue
        mid = (a + b) // 2
        m = BOUNDARY.search(text, mid, b)
        if m is None or m.start() >= b:
            last = None
            for last in BOUNDARY.finditer(text, a + 1, mid):
                pass
            m = last
        if m is not None and a < m.start() < b:
            out.append(m.start())
            stack += [(a, m.start()), (m.start(), b)]
    return sorted(out)


def pretokens(text: str, limit: int):
    """Pieces of a part that holds a long run: packed pretokens, and the halves of each long one.

    A white-space pretoken at the end of a pack is a piece of its own: together with white space before
    it, it would be split otherwise than where a visible character follows.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    start = last = end = 0

    def pack():
        if text[last:end].isspace():
            bounds = [(start, last), (last, end)]
        else:
            bounds = [(start, end)]
        return [(text[a:b], False, False) for a, b in bounds if b > a]

    for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text):
        if b - a > RUN_BYTES or b - start > limit:
            yield from pack()
            start = a
        if b - a > RUN_BYTES:
            for k, half in enumerate(halves(text[a:b], limit)):
                yield half, k > 0, True
            start = b
        last, end = a if b - a <= RUN_BYTES else b, b
    yield from pack()


# ---- DataFrame operators ------------------------------------------------------------------------

IDS_SCHEMA = "doc_id long, n_tokens long, ids binary"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _emit(codec: Codec, doc_ids: list, all_ids: list[np.ndarray], digest: bool) -> pa.RecordBatch:
    raw = [ids.astype("<u4").tobytes() for ids in all_ids]
    cols = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) for x in all_ids], pa.int64())}
    if digest:
        cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
        cols["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in all_ids], pa.string())
    else:
        cols["ids"] = pa.array(raw, pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _encoded(docs: DataFrame, vocab_path: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(_pack(vocabulary(vocab_path)))  # one vocabulary: bounded by its file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = DIGEST_SCHEMA if digest else IDS_SCHEMA

    def short(batches):
        codec = Codec(_unpack(packed.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                yield _emit(codec, part.column("doc_id").to_pylist(), [codec.encode(t) for t in texts], digest)

    def split(batches):
        codec = Codec(_unpack(packed.value))
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                leaves = list(codec.pieces(text, LEAF_CHARS))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row] * len(leaves), pa.int64()), "doc_id": pa.array([doc_id] * len(leaves), pa.int64()),
                    "leaf": pa.array(range(len(leaves)), pa.int32()), "joins": pa.array([x[1] for x in leaves], pa.bool_()),
                    "raw": pa.array([x[2] for x in leaves], pa.bool_()), "text": pa.array([x[0] for x in leaves], pa.string())})

    def encode_leaves(batches):
        codec = Codec(_unpack(packed.value))
        for batch in batches:
            ids = [codec.leaf(t, raw).tobytes() for t, raw in zip(batch.column("text").to_pylist(), batch.column("raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "leaf", "joins")), pa.array(ids, pa.binary())],
                                             names=["row", "doc_id", "leaf", "joins", "ids"])

    def join(key, table):
        codec = Codec(_unpack(packed.value))
        table = table.sort_by("leaf")
        leaves = zip((np.frombuffer(x, np.uint32) for x in table.column("ids").to_pylist()), table.column("joins").to_pylist(), strict=True)
        batch = _emit(codec, [table.column("doc_id")[0].as_py()], [codec.collect(leaves)], digest)
        return pa.Table.from_batches([batch])

    long_rows = rows.where(F.length("text") > LONG_CHARS).withColumn("row", F.monotonically_increasing_id())
    leaves = (long_rows.mapInArrow(split, "row long, doc_id long, leaf int, joins boolean, raw boolean, text string")
              .repartition("row", "leaf")
              .mapInArrow(encode_leaves, "row long, doc_id long, leaf int, joins boolean, ids binary"))
    joined = leaves.groupBy("row").applyInArrow(join, schema)
    return rows.where(F.length("text") <= LONG_CHARS).mapInArrow(short, schema).unionByName(joined)


def _pack(spec: dict) -> dict:
    return {"ranks": [(base64.b64encode(k), v) for k, v in spec["ranks"].items()], "added": spec["added"]}


def _unpack(packed: dict) -> dict:
    return {"ranks": {base64.b64decode(k): v for k, v in packed["ranks"]}, "added": packed["added"]}


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every text."""
    return _encoded(docs, vocab_path, digest=False)


def encode_digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the text decoded from them, without moving the ids out of the task."""
    return _encoded(docs, vocab_path, digest=True)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` as ``encode`` returns them; null ids give an empty text."""
    packed = encoded.sparkSession.sparkContext.broadcast(_pack(vocabulary(vocab_path)))

    def run(batches):
        codec = Codec(_unpack(packed.value))
        for batch in batches:
            texts = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
