"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: per text the sign of the summed bits of its word shingles' 64-bit hashes.

Index over the distinct fingerprints, in two parts:

* Upper nodes are masked bit patterns. The bits are cut into ``bits + 1`` blocks; fingerprints at most ``bits``
  apart agree on one block at least, so each fingerprint stands under one node (mask, pattern) per block, and a node's
  members have an accumulated difference of 0 on its mask. A node with more than ``NODE_ROWS`` members is
  replaced by finer ones (the block plus a block of the remaining bits, again ``bits + 1`` of them).
  The nodes are the keys by which Spark deals the fingerprints.
* Under each such node, the members are sorted by Gray rank and neighbours are grouped 16 by 16, level by
  level. Each group keeps the mask of bits on which all its members agree, and their pattern there. A
  search walks down from the root with the differences accumulated on the masks so far and leaves a
  whole group as soon as they exceed ``bits``, or as soon as all its members are linked to the query already.

Each task reports only links that connect something new within a node (a forest), never all pairs of a
group; connected components then run over the forest. Equal fingerprints are one entry from the start.

Results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows
get equal results; a null doc_id is kept and never chosen as smallest; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import saved, shuffle_partitions, text_buffer
from airsignal.llm.components import connected_components

#: Members of an upper node beyond which it is replaced by finer nodes, and how often at most.
NODE_ROWS = 50_000
NODE_LEVELS = 3
#: Children of a node of the tree under each upper node.
FAN = 16
#: (query, node) pairs held at once in a search.
FRONTIER = 1 << 20
#: Hashes whose bits are counted at once.
BIT_ROWS = 1 << 14

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one UTF-8 text: XXH64 (seed 42) of its lower-cased word shingles, a bit set in over half of them."""
    import xxhash

    words = text.translate(_LOWER).split()  # bytes.split() cuts at space, \t, \n, \v, \f and \r alone
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.append(0, spaces + 1)[:n].tolist()
    stops = np.append(spaces, len(line))[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BIT_ROWS):
        h = b"".join([digest(line[s:e], 42) for s, e in zip(starts[at:at + BIT_ROWS], stops[at:at + BIT_ROWS], strict=True)])
        counts += bit_counts(np.frombuffer(h, ">u8").astype(np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: the same bit of all eight bytes is summed at once, 255 hashes to a byte."""
    lanes = np.zeros(-(-len(h) // 255) * 255, np.uint64)
    lanes[:len(h)] = h
    lanes = lanes.reshape(-1, 255)
    one = np.uint64(0x0101010101010101)
    out = np.empty((8, 8), np.int64)  # byte, bit within the byte
    for bit in range(8):
        sums = ((lanes >> np.uint64(bit)) & one).sum(axis=1, dtype=np.uint64)
        out[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- index --------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray order."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Tree:
    """Levels of masked patterns over fingerprints sorted by Gray rank inside each upper node."""

    def __init__(self, fps: np.ndarray, node: np.ndarray) -> None:
        """``node``: number of the upper node of each fingerprint, nondecreasing."""
        self.fps = fps
        self.levels = []  # (first child, end child, mask, pattern, last member), from the leaves' parents up
        ones, zeros, owner = fps, ~fps, node
        child_last = np.arange(len(fps))
        while True:
            new = np.ones(len(owner), bool)
            new[1:] = owner[1:] != owner[:-1]
            at = np.flatnonzero(new)
            rank = np.arange(len(owner)) - np.repeat(at, np.diff([*at, len(owner)]))
            first = np.flatnonzero(rank % FAN == 0)
            end = np.append(first[1:], len(owner))
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            owner, child_last = owner[first], child_last[end - 1]
            self.levels.append((first, end, ones | zeros, ones, child_last))
            if len(np.unique(owner)) == len(owner):
                break
        self.root_owner = owner  # upper node of each root

    def links(self, node: np.ndarray, bits: int):
        """Pairs (i, j) of member numbers, i < j, at most ``bits`` apart, that connect something new."""
        parent = np.arange(len(self.fps))
        step = max(1, FRONTIER // 256)
        root = np.searchsorted(self.root_owner, node)
        top = len(self.levels) - 1
        for at in range(0, len(self.fps), step):
            q = np.arange(at, min(at + step, len(self.fps)))
            # a group whose members all have the query's label holds nothing new
            uniform = self._uniform(parent)
            stack = [(top, q, root[q])]
            while stack:
                level, qi, ni = stack.pop()
                if len(qi) > FRONTIER // FAN and len(qi) > 1:
                    mid = len(qi) // 2
                    stack += [(level, qi[mid:], ni[mid:]), (level, qi[:mid], ni[:mid])]
                    continue
                first, end, mask, pattern, last = self.levels[level]
                near = np.bitwise_count((self.fps[qi] ^ pattern[ni]) & mask[ni]) <= bits
                near &= (last[ni] > qi) & (uniform[level][ni] != parent[qi])
                qi, ni = qi[near], ni[near]
                if not len(qi):
                    continue
                width = end[ni] - first[ni]
                qi = np.repeat(qi, width)
                child = np.repeat(first[ni] - np.cumsum(width) + width, width) + np.arange(len(qi))
                if level:
                    stack.append((level - 1, qi, child))
                    continue
                hit = (child > qi) & (np.bitwise_count(self.fps[qi] ^ self.fps[child]) <= bits)
                yield from self._forest(parent, qi[hit], child[hit])

    def _uniform(self, parent: np.ndarray) -> list[np.ndarray]:
        out, low, high = [], parent, parent
        for first, *_ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out

    @staticmethod
    def _forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray):
        """Hook the pairs' trees onto smaller ones until none differ; yield the pairs used."""
        while len(i):
            a, b = parent[i], parent[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            head = order[np.append(True, high[order][1:] != high[order][:-1])]
            parent[high[head]] = low[head]  # labels only sink, so no cycle
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up
            yield i[head], j[head]


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    size = -(-len(free) // parts)
    return [free[k:k + size] for k in range(0, len(free), size)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _children(masks: list[tuple[int, list[int]]], parts: int) -> list[tuple[int, int, list[int]]]:
    """(parent mask, mask, bits) of the finer nodes."""
    out = []
    for m, used in masks:
        free = [b for b in range(64) if b not in used]
        out += [(m, _mask(used + block), used + block) for block in _blocks(free, parts)]
    return out


def links(fps: DataFrame, bits: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links between distinct values of the long column ``fp`` whose closure is that of all pairs at most ``bits`` apart."""
    parts = bits + 1
    level = _children([(0, [])], parts)
    entry = F.explode(F.array(*[F.lit(m) for _, m, _ in level])).alias("mask")
    keyed = fps.select("fp", entry)
    nodes = None
    for depth in range(NODE_LEVELS):
        keyed = keyed.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        if depth == NODE_LEVELS - 1:
            dealt = keyed
        else:
            full = saved(keyed.groupBy("mask", "pattern").count().where(F.col("count") > node_rows).select("mask", "pattern"), "nodes")
            if full.isEmpty():
                dealt, keyed = keyed, None
            else:
                dealt = keyed.join(full, ["mask", "pattern"], "left_anti")
                finer: dict[int, list[int]] = {}
                level = _children([(m, used) for _, m, used in level], parts)
                for parent, m, _ in level:
                    finer.setdefault(parent, []).append(m)
                table = F.create_map(*[x for p, ms in finer.items() for x in (F.lit(p), F.array(*map(F.lit, ms)))])
                keyed = keyed.join(full, ["mask", "pattern"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        nodes = dealt if nodes is None else nodes.unionByName(dealt)
        if keyed is None:
            break

    def search(batches):
        held: list[pa.Table] = []

        def solve(t: pa.Table):
            mask, pattern = (t.column(c).to_numpy() for c in ("mask", "pattern"))
            fp = t.column("fp").to_numpy().view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])
            node = np.cumsum(new)
            order = np.lexsort((gray_rank(fp), node))
            fp, node = fp[order], node[order]
            for i, j in Tree(fp, node).links(node, bits):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

        for batch in batches:  # sorted by node: whole nodes are solved as they come, the last waits for its rest
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < NODE_ROWS:
                continue
            t = pa.concat_tables(held)
            mask, pattern = (t.column(c).to_numpy() for c in ("mask", "pattern"))
            other = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from solve(t.slice(0, cut))
            held = [t.slice(cut)]
        if held and (t := pa.concat_tables(held)).num_rows:
            yield from solve(t)

    return (nodes.select("mask", "pattern", "fp")
            .repartition(shuffle_partitions(fps), "mask", "pattern").sortWithinPartitions("mask", "pattern")
            .mapInArrow(search, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row."""
    marks = saved(fingerprints(docs, shingle), "simhash")
    distinct = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    comps = connected_components(links(distinct.select("fp"), bits, node_rows))
    classes = (distinct.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left")
               .select("fp", F.coalesce("component", "fp").alias("component"), "first_id"))
    classes = saved(classes, "classes")
    smallest = saved(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = saved(classes.join(smallest, "component").select("fp", "component_id"), "classes")
    return (marks.join(classes, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows that stay, with all columns: of each component the row with the smallest doc_id.

    A row without doc_id stays only if its component has no other; rows that share a doc_id that stays all stay.
    """
    found = saved(near_duplicates(docs, shingle, bits, node_rows), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).where("not stays").select("doc_id")
    return docs.alias("d").join(gone.alias("g").hint("shuffle_hash"), F.expr("cast(d.doc_id as bigint) <=> g.doc_id"), "left_anti")
