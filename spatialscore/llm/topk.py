"""Exact top-k search by inner product over integer vectors.

Vectors are packed into matrices where they are read. Every tile is a product of a query block and a shard block; only
the best ``k`` of each query in a tile leave it, and partial lists are merged per task and then over all tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "dim int, ids binary, matrix binary"
HITS = "query_id long, vec_id long, score long"
LIMB, COLUMNS_AT_ONCE = 20, 4096
EXACT = float(1 << 53)


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; NULL if the vector or a component is NULL or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double")))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of at most ``block`` vectors of one dimension from (vec_id, v), packed in each input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            matrix = np.concatenate(vectors).astype("<f8")
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                 pa.array([matrix.tobytes()], pa.binary())], names=["dim", "ids", "matrix"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for start in range(0, len(at), block):
                    part = at[start:start + block]
                    pick = offsets[part][:, None] + np.arange(dim)
                    a, b = held.setdefault(int(dim), ([], []))
                    a.append(ids[part])
                    b.append(flat[pick].reshape(len(part), dim))
                    if sum(map(len, a)) >= block:
                        yield out(int(dim))
        for dim in list(held):
            yield out(dim)

    return rows.select("vec_id", "v").mapInArrow(run, BLOCKS)


def tile_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits the largest or smallest long.

    Whole doubles multiply exactly below 2^53. Larger ones are cut into limbs of 20 bits, whose products are added up
    modulo 2^64; that is exact for every product that fits a long, and the plain product tells which do not.
    """
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    a, b = limbs(q), limbs(v)
    total = np.zeros((len(q), len(v)), dtype=np.uint64)
    for i, x in enumerate(a):
        for j, y in enumerate(b[:4 - i]):
            for start in range(0, q.shape[1], COLUMNS_AT_ONCE):
                part = x[:, start:start + COLUMNS_AT_ONCE] @ y[:, start:start + COLUMNS_AT_ONCE].T
                total += part.astype(np.uint64) << np.uint64(LIMB * (i + j))
    out = total.view(np.int64).copy()
    with np.errstate(over="ignore", invalid="ignore"):
        plain, size = q @ v.T, np.abs(q) @ np.abs(v).T
        slack = size * 2.0 ** -40
        over = np.abs(plain) - slack >= 2.0 ** 63
        doubtful = ~over & ~(np.abs(plain) + slack < 2.0 ** 63)
    out[over] = np.where(plain[over] > 0, (1 << 63) - 1, -(1 << 63))
    for i, j in zip(*np.nonzero(doubtful)):
        exact = sum(int(x) * int(y) for x, y in zip(q[i], v[j]))
        out[i, j] = max(-(1 << 63), min((1 << 63) - 1, exact))
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole doubles modulo 2^64 as four limbs of 20 bits, the lowest first."""
    rest = np.fmod(x, 2.0 ** 64)
    rest = np.abs(rest).astype(np.uint64) * np.where(rest < 0, np.uint64((1 << 64) - 1), np.uint64(1))
    return [((rest >> np.uint64(LIMB * k)) & np.uint64((1 << LIMB) - 1)).astype(float) for k in range(4)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = 2048, query_block: int = 1024, shards: int | None = None) -> DataFrame:
    """The ``k`` best vectors of every query: (query_id, rank, vec_id, score).

    Ties go to the smaller id; a query never finds rows of its own id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; vectors meet those of the same length only, and
    empty ones score 0. A candidate id that is repeated is listed once per row, a query id that is repeated asks once
    with its smallest vector. Products that leave 64 bits are not defined. Other columns are not read.

    Shard blocks go to ``shards`` groups by hash and query blocks to each of them, so a vector is sent once and a
    query ``shards`` times, both as packed blocks; a task holds one tile and its running lists. Unless given, groups are
    as many as shuffle partitions, but beyond the cores' number no more than make the copies of the queries as many as
    the vectors.
    """
    spark = vectors.sparkSession
    form = lambda d: d.select(d[id_col].cast("long").alias("vec_id"), quantise(d[vector_col]).alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL")
    asked = form(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    if shards is None:
        fair = -(-vectors.count() // max(1, queries.count()))
        shards = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, fair))
    q = packed(asked, query_block).select(
        "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    v = packed(form(vectors), block).withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    # Spark sizes the queries as they were before they were copied and would collect all copies on the driver to broadcast
    # them, so the join is told to shuffle.
    tiles = v.join(q.hint("merge"), ["s", "dim"]).select("dim", "q_ids", "q", "ids", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out(held: dict) -> Iterator[pa.RecordBatch]:
            for name, (qs, ids, scores) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(ids), pa.array(scores)],
                                                 names=["query_id", "vec_id", "score"])

        for batch in batches:
            for dim, q_ids, q, ids, m in zip(*(batch.column(i) for i in range(5))):
                dim, key = dim.as_py(), q_ids.as_py()
                qi, vi = np.frombuffer(key, "<i8"), np.frombuffer(ids.as_py(), "<i8")
                scores = tile_scores(np.frombuffer(q.as_py(), "<f8").reshape(len(qi), dim),
                                     np.frombuffer(m.as_py(), "<f8").reshape(len(vi), dim))
                found = []
                for i, own in enumerate(qi):
                    at = best(scores[i], vi, k + int((vi == own).sum()))
                    at = at[vi[at] != own][:k]
                    found.append((np.full(len(at), own), vi[at], scores[i][at]))
                part = tuple(np.concatenate(x) for x in zip(*found))
                lists[key] = merged(lists[key], part, k) if key in lists else part
                if len(lists) > 64:
                    yield from out(lists)
                    lists = {}
        yield from out(lists)

    partial = tiles.mapInArrow(run, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged(a: tuple, b: tuple, k: int) -> tuple:
    """The k best of two sets of per-query lists."""
    qs, ids, scores = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((ids, -scores, qs))
    qs, ids, scores = qs[order], ids[order], scores[order]
    start = np.searchsorted(qs, qs, side="left")
    keep = np.arange(len(qs)) - start < k
    return qs[keep], ids[keep], scores[keep]
