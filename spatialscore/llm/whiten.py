"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations of its columns.

Vectors become whole numbers. The fit list holds each distinct vector once; counts, sums and the scatter of the centred
list are added up on the cluster and only matrices of the vectors' dimension reach the driver. The scatter divided by the
list's length is factored as L L' with pivots, and the columns of L are rotated until they are orthogonal: then their
squared norms are the eigenvalues and their directions the eigenvectors, to the accuracy of each eigenvalue itself.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are set to it, so that sums of them stay whole numbers.
LARGEST = float(1 << 40)
ROWS_AT_ONCE = 2048
#: An eigenvalue below this share of the largest counts as zero, since rounding alone makes as much.
LEAST_SHARE = 1e-14


def whole(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of every entry; NULL for a vector that is null or empty or has null or non-finite entries."""
    entry = lambda c: c.cast("double")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    scaled = lambda c: F.least(F.greatest(F.floor(entry(c) * SCALE).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)),
                  F.transform(vector, lambda c: scaled(c).cast("long") + SHIFT))


def pivoted_cholesky(v: np.ndarray, least: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L', L lower trapezoidal, largest remaining pivot first.

    Ends at a pivot below ``least`` of the first, so L has as many columns as v has rank.
    """
    d = len(v)
    order, rest = np.arange(d), np.array(v, dtype=float)
    factor = np.zeros((d, d))
    first = max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        pivot = rest[p, p]
        if not pivot > least * first:
            return factor[:, :k], order
        for m in (rest, factor, order):
            m[[k, p]] = m[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        factor[k, k] = np.sqrt(pivot)
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal; disjoint pairs are turned together."""
    a = np.array(factor, dtype=float)
    n = a.shape[1]
    if n < 2:
        return a
    seats = list(range(n + n % 2))
    half = len(seats) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[half:][::-1]) if max(p, q) < n]
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if turn.any():
                turned = True
                p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
                z = (yy - xx)[turn] / (2 * xy[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a covariance matrix, falling, and their unit eigenvectors as columns.

    A sign is fixed for each: its largest entry (the first of equals) is positive.
    """
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    rank = rank[values[rank] > LEAST_SHARE * values.max(initial=0.0)]
    vectors = np.zeros((len(v), len(rank)))
    vectors[order] = turned[:, rank] / np.sqrt(values[rank])
    lead = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0) if len(v) else np.ones((1, 0))
    return values[rank], vectors * np.sign(lead)


@dataclass(frozen=True)
class Whitening:
    """Fit of one list of vectors: n, exact sums, covariance trace, eigenvalues and components (as columns)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, taken from the nearest whole numbers first so that no digits are lost."""
        return _centred(x, self.n, self.sums)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    near = [round(s / n) if abs(s) < 1 << 52 else s // n for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])
    return (x - np.array(near, dtype=np.int64)).astype(float) - rest


def _blocks(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(vectors: DataFrame, d: int, width: int, part) -> np.ndarray:
    """Sum over all rows of ``part(block)``, a matrix of ``width`` columns: one matrix per task, then one sum per entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "x", d):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(float))], names=["i", "j", "v"])
    rows = vectors.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors of column ``x`` (array<long>, all of one length); None without any.

    Vectors that are all equal have no components.
    """
    distinct = stored(vectors.select("x").distinct())
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    sums_of = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = tuple(int(r["s"]) for r in sorted(sums_of.collect(), key=lambda r: r["i"]))
    n = distinct.count()

    def scatter(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        return c.T @ c
    covariance = _summed(distinct, d, d, scatter) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors_of = eigen(covariance)
    values, vectors_of = values[:components], vectors_of[:, :components]
    k = len(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ vectors_of / np.sqrt(values)
        return np.vstack([w.T @ w, w.sum(axis=0)])
    error = 0.0
    if k:
        total = _summed(distinct, d, k, products) / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return Whitening(n, sums, float(np.trace(covariance)), values, vectors_of, error)


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums over dimensions of (n x - S) squared; None where a long can't hold it."""
    near = [s // model.n for s in model.sums]
    rest = np.array([s - model.n * m for s, m in zip(model.sums, near)], dtype=np.int64)
    off = x - np.array(near, dtype=np.int64)
    if (int(np.abs(off).max(initial=0)) * model.n + model.n) ** 2 * x.shape[1] < 1 << 63:
        return ((off * model.n - rest) ** 2).sum(axis=1).tolist()
    exact = (int(sum((int(o) * model.n - int(r)) ** 2 for o, r in zip(row, rest))) for row in off)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: (id_col, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null, empty, or holds null or non-finite entries give none. Vectors of another length than the
    most frequent one (the longest of equally frequent) can't be compared with it and give none either. There are fewer
    components than asked for where the fit list has fewer directions, and none where all vectors are equal.
    ``deviation`` is null where it does not fit a long. Repeated rows stay repeated rows; other columns are not read.
    """
    rows = stored(vectors.select(vectors[id_col].alias("id"), whole(vectors[vector_col]).alias("x")).where("x IS NOT NULL"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.size("x") == d)
    model = fit(rows, components)
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
              ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in fields)])
    k = len(model.values) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        share = model.values / model.trace
        for part, x in _blocks(batches, "x", d):
            w = model.centred(x) @ model.vectors / np.sqrt(model.values)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(_deviations(x, model), pa.int64()).take(at), pa.array(w.ravel()),
                 pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))], names=["id", *(c for c, _ in fields)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
