"""Near-duplicate components by MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class. Classes that share a band of signature values are candidates; their
signatures are compared in batches, and a pair is given up as soon as the posterior probability that its similarity
reaches the threshold is below ``miss``. What is left is verified on the full sets.

Pairs within a bucket are not all formed: first every member meets the bucket's leader, the one that shares most buckets
with others. After the links that this finds, only members outside the leader's component meet the rest, in tiles of
bounded size that are verified where they are. A link that is not looked at joins two documents of one component already.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, stored
from .graph import components

# Fixed pattern of a word.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans(UPPER, LOWER)
REMEMBERED_WORDS = 400_000
TILE = 256


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** rows) ** bands, 3e-6 here."""

    shingle: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 4
    batch: int = 16
    miss: float = 1e-7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[int]:
        """Matches after each batch below which a pair is given up.

        With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), so its mass above the
        threshold t is P(Binomial(n + 1, t) <= m).
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            mass, m = 0.0, -1
            while mass < self.miss:
                m += 1
                mass += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return out


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.translate(LOWERED))
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = h
        return h


_WORDS = _Words()
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, size=(2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = WORD.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * _ODD[0, 0] + w[i:len(w) - n + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0, 1]
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """MinHash signature of 32-bit values; long sets are taken in pieces."""
    out = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 8192):
        x = _ODD[0, :size, None] * hashes[None, start:start + 8192]
        x += _ODD[1, :size, None]
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame, cfg: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, sig): set size, digest of the set and signature of every whole text; key and sig null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), cfg.shingle)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, cfg.hashes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             names=["id", "n", "key", "sig"])
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n long, key binary, sig binary")


def _matrix(column: pa.Array, cfg: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, cfg.hashes)


def band_keys(classes: DataFrame, cfg: Settings) -> DataFrame:
    """(bucket, id): one row for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1), cfg).reshape(-1, cfg.bands, cfg.rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(cfg.bands, dtype=np.uint64), sig.shape[:2]) + np.uint64(1)
            for r in range(cfg.rows):
                key = ((key ^ (key >> np.uint64(31))) + sig[:, :, r]) * _ODD[1, r]
            key = key ^ (key >> np.uint64(29))
            offsets = np.arange(len(sig) + 1, dtype=np.int32) * cfg.bands
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "buckets"])
    keyed = classes.select("id", "sig").mapInArrow(run, "id long, buckets array<long>")
    return keyed.select(F.explode("buckets").alias("bucket"), "id")


def likely(pairs: DataFrame, classes: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (a, b) that survive the size bound and the sequential comparison of signatures."""
    least = cfg.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = compared(_matrix(batch.column(2), cfg), _matrix(batch.column(3), cfg), cfg, least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * cfg.percent)
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def compared(x: np.ndarray, y: np.ndarray, cfg: Settings, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices stay, batch after batch; given-up rows are not looked at again."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for step, low in enumerate(least):
        part = slice(step * cfg.batch, (step + 1) * cfg.batch)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= low]
    keep = np.zeros(len(x), dtype=bool)
    keep[alive] = True
    return keep


def verified(pairs: DataFrame, texts: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last or held is None:
                    last, held = a, shingles(ta.as_py(), cfg.shingle)
                keep.append(linked(held, shingles(tb.as_py(), cfg.shingle), cfg))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return stored(joined.mapInArrow(run, "a long, b long"))


def linked(x: np.ndarray, y: np.ndarray, cfg: Settings) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= cfg.percent * (len(x) + len(y) - both)


def across(crowd: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, cfg: Settings) -> DataFrame:
    """Verified links (a, b) between members of one bucket that are in different components.

    The leader has met everyone, and members of its component need not meet each other. The others meet them and each
    other, in tiles of at most about TILE by TILE rows; a tile emits the links that join its components, no more.
    """
    least = cfg.least_matches()
    root_of = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
    rows = (crowd.where("id <> leader").join(root_of("id", "r"), "id", "left").join(root_of("leader", "lr"), "leader", "left")
            .select("bucket", "id", F.coalesce("r", "id").alias("root"), F.coalesce("lr", "leader").alias("top"))
            .withColumn("own", F.col("root") == F.col("top")))
    out = (~F.col("own")).cast("long")
    sizes = rows.groupBy("bucket").agg(F.sum(out).alias("apart"), F.sum(1 - out).alias("inside")).where("apart > 1 OR apart = 1 AND inside > 0")
    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    placed = rows.join(sizes.select("bucket", blocks("apart").alias("na"), blocks("inside").alias("ni")), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("ni")).otherwise(F.col("na"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    b = F.col("block")
    inside = F.transform(upto(F.col("na")), lambda i: tile(1, i, b))
    apart = F.concat(F.transform(upto(F.col("na")), lambda j: tile(0, F.least(b, j), F.greatest(b, j))),
                     F.transform(upto(F.col("ni")), lambda j: tile(1, b, j)))
    tiles = (placed.withColumn("t", F.explode(F.when(F.col("own"), inside).otherwise(apart)))
             .join(classes.select("id", "n", "sig"), "id").join(texts, "id")
             .select("bucket", "t.kind", "t.i", "t.j", "own", "block", "id", "root", "n", "sig", "text")
             .repartition("bucket", "kind", "i", "j").sortWithinPartitions("bucket", "kind", "i", "j"))

    def links_of(rows: pa.Table) -> list[tuple[int, int]]:
        kind, i, j = (rows.column(c)[0].as_py() for c in ("kind", "i", "j"))
        own, block, ids, roots, n = (rows.column(c).to_numpy() for c in ("own", "block", "id", "root", "n"))
        sig = _matrix(rows.column("sig"), cfg)
        left = np.flatnonzero(~own & (block == i))
        right = np.flatnonzero(own) if kind else np.flatnonzero(block == j)
        fits = roots[left][:, None] != roots[right][None, :]
        fits &= np.minimum.outer(n[left], n[right]) * 100 >= np.maximum.outer(n[left], n[right]) * cfg.percent
        if not kind and i == j:
            fits &= left[:, None] < right[None, :]
        first = slice(0, cfg.batch)
        for row, x in enumerate(left):
            y = np.flatnonzero(fits[row])
            fits[row, y] = (sig[right[y], first] == sig[x, first]).sum(axis=1) >= least[0]
        xs, ys = np.nonzero(fits)
        xs, ys = left[xs], right[ys]
        keep = compared(sig[xs], sig[ys], cfg, least)
        texts, sets, parent, out = rows.column("text"), {}, {}, []

        def top(r: int) -> int:
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        def set_of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingles(texts[x].as_py(), cfg.shingle)
            return sets[x]
        for x, y in zip(xs[keep].tolist(), ys[keep].tolist()):
            a, b = top(int(roots[x])), top(int(roots[y]))
            if a != b and linked(set_of(x), set_of(y), cfg):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key = np.column_stack([table.column(c).to_numpy() for c in ("bucket", "kind", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield batch_of(links_of(table.slice(a, b - a)))
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows > 1:
            yield batch_of(links_of(rest))
    return stored(tiles.mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_shingles, class_id, component_id, kept).

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the smallest id reachable by links,
    itself included, and ``kept`` marks the document that has it. Null and wordless texts have no shingles and are
    linked with nothing. Rows that repeat an id are linked with each other; a row without an id is linked with
    nothing and kept. Extra columns are not read. Links are lost with the probabilities that ``Settings`` names only.
    """
    sets = stored(sketches(docs, cfg, id_col, text_col))
    of_key = sets.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("class_id"))
    member = stored(sets.select("id", "n", "key").join(of_key, "key", "left").select("id", "n", "class_id"))
    classes = stored(sets.join(of_key.select(F.col("class_id").alias("id"), "key"), ["id", "key"], "left_semi").select("id", "n", "sig"))
    bands = stored(band_keys(classes, cfg))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(bands.join(shared, "bucket").select("bucket", "id", "size"))
    discard(bands)
    # The centre of a family of copies shares more buckets with its members than they do with each other.
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    lead = met.join(degree, "id").groupBy("bucket").agg((-F.max(F.struct("degree", (-F.col("id")).alias("m")))["m"]).alias("leader"))
    crowd = stored(met.join(lead, "bucket").select("bucket", "id", "leader"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    texts = stored(texts.join(degree.select("id"), "id", "left_semi"))
    own = member.where("class_id <> id").select(F.col("id").alias("a"), F.col("class_id").alias("b")).join(
        classes.select(F.col("id").alias("a")), "a", "left_semi")
    stars = stored(likely(crowd.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), classes, cfg))
    first = verified(stars, texts, cfg)
    roots = components(first.unionByName(own))
    links = across(crowd, roots, classes, texts, cfg)
    root = lambda d, c: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c))
    joined = components(root(root(links, "a"), "b").select("a", "b")).withColumnsRenamed({"node": "mid", "root": "top"})
    all_rows = member.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("mid", F.coalesce("root", "class_id"))
    found = all_rows.join(joined, "mid", "left").withColumn("component_id", F.coalesce("top", "mid", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"),
                        "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
