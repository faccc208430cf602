"""Near-duplicate components by SimHash with a Gray-order hierarchical index.

Distinct fingerprints are the leaves. An upper node is a masked bit pattern that its fingerprints share. The masks of the
top level are the segments of a fingerprint: two fingerprints that differ in at most ``distance`` bits share the bits of
at least one of ``distance + 1`` segments, so they meet under one of its nodes. A node with more fingerprints than one
task should hold passes them to nodes below it, whose masks add a segment of the bits left; the bits run out before a
small node can be overfull, so every node at the end is bounded whatever the data.

Within such a node fingerprints are sorted by Gray rank, which puts those next to each other that differ in few bits.
Runs of neighbours are factored into groups, groups of groups and so on, each with the mask of the bits that all its
members share and their pattern. Pairs of groups are walked from the top; the differences in bits that both share add up,
and a pair beyond the distance goes with all its members.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, heavy_join, stored
from .graph import components

# Fixed pattern of a word and fixed values of the fingerprint.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
BITS, SEED = 64, 42
#: Fingerprints of one node that a task compares; more go to nodes of finer masks.
NODE = 4096
#: Members of a group of the index.
FAN = 8
PAIRS_AT_ONCE, LINKS_AT_ONCE = 1 << 15, 1 << 13
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Bits that are set in over half the hashes of the shingles, repeats included; zero without words."""
    words = WORD.findall((text or "").encode().translate(LOWERED))
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[:-shingle].tolist()], (ends[shingle - 1:] - 1).tolist()
    set_bits = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(ends), SHINGLES_AT_ONCE):
        part = zip(starts[k:k + SHINGLES_AT_ONCE], ends[k:k + SHINGLES_AT_ONCE])
        hashes = np.frombuffer(b"".join([digest(line[a:b], seed=SEED) for a, b in part]), dtype=np.uint8)
        set_bits += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code): the fingerprint of every whole text as a signed long. Null and wordless texts have zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["id", "code"])
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, as a signed long of the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-1 << 63))


def finer(mask: int, parts: int) -> list[int]:
    """The masks below ``mask`` (signed longs): each adds one of ``parts`` segments of the bits that it leaves."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    ends = [len(free) * k // parts for k in range(parts + 1)]
    wide = [(mask | sum(1 << b for b in free[a:b])) % (1 << BITS) for a, b in zip(ends, ends[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in wide]


def finer_masks(mask: Column, distance: int) -> Column:
    def run(masks: pa.Array) -> pa.Array:
        known = {m: finer(m, distance + 1) for m in masks.unique().to_pylist()}
        return pa.array([known[m] for m in masks.to_pylist()], pa.list_(pa.int64()))
    return F.arrow_udf(run, "array<long>")(mask)


def upper_nodes(codes: DataFrame, distance: int, node: int = NODE) -> DataFrame:
    """(mask, pattern, code, id): distinct codes below the upper nodes that hold two to ``node`` of them.

    Any two codes within ``distance`` share at least one such node. Codes of a node with more go to the nodes below it,
    under each of its ``distance + 1`` finer masks. A mask that leaves so few bits that they can't tell more than
    ``node`` codes apart is the last.
    """
    out, above = None, codes.select("id", "code", F.lit(0).cast("long").alias("mask"))
    while out is None or not above.isEmpty():
        below = above.select("id", "code", F.explode(finer_masks(F.col("mask"), distance)).alias("mask"))
        # Different choices of segments may end in the same mask.
        below = stored(below if out is None else below.distinct())
        below = below.withColumn("pattern", F.col("code").bitwiseAND(F.col("mask")))
        sizes = stored(below.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        held = stored(heavy_join(below, sizes, ["mask", "pattern"], "size", how="inner"))
        over = (F.col("size") > node) & (F.bit_count("mask") < BITS - node.bit_length() + 1)
        out = held.where(~over) if out is None else out.unionByName(held.where(~over))
        above = held.where(over).select("id", "code", "mask")
    return out.select("mask", "pattern", "code", "id")


class Index:
    """Groups of groups over the Gray-sorted codes of many nodes at once.

    ``mask`` and ``bits`` of level 0 are the codes themselves; FAN neighbours of one node make a group of the next level,
    with the bits that all share. ``first`` are the children's offsets. The last level has one group for each node.
    """

    def __init__(self, codes: np.ndarray, node: np.ndarray):
        self.mask, self.bits = [np.full(len(codes), ~np.uint64(0))], [codes]
        self.first: list[np.ndarray] = []
        while len(node) and (node[1:] == node[:-1]).any():
            new = np.append(True, node[1:] != node[:-1])
            place = np.arange(len(node)) - np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
            first = np.flatnonzero(place % FAN == 0)
            bits, mask = self.bits[-1], self.mask[-1]
            lead = np.repeat(bits[first], np.diff(np.append(first, len(node))))
            mask = np.bitwise_and.reduceat(mask & ~(bits ^ lead), first)
            self.mask.append(mask)
            self.bits.append(bits[first] & mask)
            self.first.append(first)
            node = node[first]
        self.roots = len(node)

    def near(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (x < y) of codes of one node that differ in at most ``distance`` bits."""
        top = len(self.first)
        root = np.arange(self.roots)
        waiting = [(top, root, root)]
        while waiting:
            level, x, y = waiting.pop()
            if len(x) > PAIRS_AT_ONCE:
                half = len(x) // 2
                waiting += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
                continue
            shared = self.mask[level][x] & self.mask[level][y]
            fits = np.bitwise_count((self.bits[level][x] ^ self.bits[level][y]) & shared) <= distance
            x, y = x[fits], y[fits]
            if level == 0:
                yield x[x < y], y[x < y]
                continue
            if not len(x):
                continue
            ends = np.append(self.first[level - 1], len(self.bits[level - 1]))
            n_x, n_y = ends[x + 1] - ends[x], ends[y + 1] - ends[y]
            each = np.repeat(np.arange(len(x)), n_x * n_y)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(n_x * n_y) - n_x * n_y, n_x * n_y)
            a, b = ends[x][each] + nth // n_y[each], ends[y][each] + nth % n_y[each]
            waiting.append((level - 1, a[a <= b], b[a <= b]))


def top(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        x = root[x]
    return x


def near_links(codes: DataFrame, distance: int, node: int = NODE) -> DataFrame:
    """Links (a, b) between the ids of distinct ``codes`` (id, code) that differ in at most ``distance`` bits.

    Of the links of one node, those that join what others of it join already are left out; so a node gives fewer links
    than it has codes, and the components are those of all links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            mask, pattern, code, ids = (table.column(c).to_numpy() for c in ("mask", "pattern", "code", "id"))
            node = np.cumsum(np.append(False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])))
            root = np.arange(len(code))
            a, b = [], []
            for x, y in Index(code.view(np.uint64), node).near(distance):
                for k in range(0, len(x), LINKS_AT_ONCE):
                    u, v = x[k:k + LINKS_AT_ONCE], y[k:k + LINKS_AT_ONCE]
                    new = root[u] != root[v]
                    for p, q in zip(u[new].tolist(), v[new].tolist()):
                        r, s = top(root, p), top(root, q)
                        if r != s:
                            root[max(r, s)] = min(r, s)
                            a.append(p)
                            b.append(q)
                    while (root[root] != root).any():
                        root = root[root]
            return pa.RecordBatch.from_arrays([pa.array(ids[a] if a else ids[:0]), pa.array(ids[b] if b else ids[:0])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            mask, pattern = table.column("mask").to_numpy(), table.column("pattern").to_numpy()
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield links(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows > 1:
            yield links(rest)

    nodes = upper_nodes(codes, distance, node)
    dealt = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("code")))
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, fingerprint, class_id, component_id, kept).

    ``fingerprint`` is 16 lower-case hex digits, ``class_id`` the smallest id with the same fingerprint, and
    ``component_id`` the smallest id reachable by links of at most ``distance`` differing bits, itself included. Texts
    that are null, empty or without words have fingerprint zero and are linked like any other. Rows that repeat an id are
    one node of the graph; a row without an id is linked with nothing, has no component and is kept. Extra columns are
    not read. All links are found: no node, group or pair is left out by a bound.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col))
    classes = stored(rows.where("id IS NOT NULL").groupBy("code").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    links = near_links(classes.select(F.col("class_id").alias("id"), "code"), distance)
    # A repeated id with several texts has several fingerprints, whose classes it joins.
    own = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low <> high")
    spread = rows.join(own.select("id"), "id", "left_semi").join(classes.select("code", "class_id"), "code").select(
        F.col("id").alias("a"), F.col("class_id").alias("b"))
    roots = components(links.unionByName(spread))
    found = stored(classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "code", "class_id", F.coalesce("root", "class_id").alias("component_id"), "copies"))
    joined = heavy_join(rows, found, "code", "copies")
    real = F.col("id").isNotNull()
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
                         F.when(real, F.col("class_id")).alias("class_id"), F.when(real, F.col("component_id")).alias("component_id"),
                         F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
