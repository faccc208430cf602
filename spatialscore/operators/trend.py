"""Least-squares trends and variogram fits from sums over the rows."""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, default_buckets, written
from .compare import arg_max
from .lattice import Layer, basis_row
from .sparse import conjugate_gradients


@dataclass(frozen=True)
class Trend:
    """Fitted coefficients; ``terms`` maps a name to its Column."""

    intercept: float
    slopes: dict[str, float]
    terms: dict[str, Column]
    r2: float
    n: int

    def fitted(self) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(self.slopes[t]) * c for t, c in self.terms.items()], F.lit(self.intercept))


def product_terms(names: list[str]) -> dict[str, Column]:
    """All main effects and interactions of the named columns."""
    out: dict[str, Column] = {}
    for mask in range(1, 2 ** len(names)):
        picked = [n for i, n in enumerate(names) if mask >> i & 1]
        out[":".join(picked)] = reduce(lambda a, b: a * b, [F.col(p) for p in picked])
    return out


def ols(df: DataFrame, y: str, terms: dict[str, Column]) -> Trend:
    """M7: least squares with intercept. One pass collects means and covariances (a p x p table)."""
    names = list(terms)
    rows = df.select(F.col(y).cast("double").alias("_y"), *[terms[t].cast("double").alias(f"_x{i}") for i, t in enumerate(names)]).dropna()
    cols = [f"_x{i}" for i in range(len(names))] + ["_y"]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in cols],
                 *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    p = len(names)
    cov = np.empty((p + 1, p + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    scale = np.sqrt(np.diag(cov)[:p])
    b = np.linalg.solve(cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale) / scale
    icpt = r["m_y"] - sum(b[i] * r[f"m_x{i}"] for i in range(p))
    r2 = float(b @ cov[:p, p] / cov[p, p]) if cov[p, p] > 0 else float("nan")
    return Trend(float(icpt), dict(zip(names, map(float, b))), terms, r2, r["n"])


def detrend(df: DataFrame, y: str, terms: dict[str, Column]) -> DataFrame:
    """M9: fitted value and residual of every row."""
    t = ols(df, y, terms)
    return df.withColumn("fitted", t.fitted()).withColumn("residual", F.col(y) - F.col("fitted"))


def variogram_fit(vg: DataFrame, bounds: dict[str, tuple[float, float]], steps: int = 64, rounds: int = 3) -> DataFrame:
    """Unweighted least squares of nugget + sill (1 - exp(-h / range)) inside a box.

    Given the range the rest is linear, so every range on a grid needs only sums over the lags: the free
    solution if it lies in the box, else the best point of the four sides. Each round puts ``steps``
    ranges over one grid step around the best one so far.
    """
    (s0, s1), (n0, n1) = ((float(a), float(b)) for a, b in (bounds["sill"], bounds["nugget"]))
    first = lo, hi = tuple(map(float, bounds["range"]))
    clip = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    best = None
    for i in range(rounds):
        width = (hi - lo) / (steps - 1)
        g = vg.select("h", "gamma", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("point"))
        g = g.withColumn("range", F.lit(lo) + F.col("point") * F.lit(width)).withColumn("g", F.lit(1.0) - F.exp(-F.col("h") / F.col("range")))
        t = g.groupBy("point", "range").agg(
            F.count(F.lit(1)).cast("double").alias("m"), F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sgg"),
            F.sum("gamma").alias("sy"), F.sum(F.col("g") * F.col("gamma")).alias("sgy"), F.sum(F.col("gamma") * F.col("gamma")).alias("syy"))
        m, sg, sgg, sy, sgy, syy = (F.col(c) for c in ("m", "sg", "sgg", "sy", "sgy", "syy"))
        free_s = (m * sgy - sg * sy) / (m * sgg - sg * sg)
        free_n = (sy - free_s * sg) / m
        side_n = lambda s: clip((sy - F.lit(s) * sg) / m, n0, n1)
        side_s = lambda n: clip((sgy - F.lit(n) * sg) / sgg, s0, s1)
        points = [(clip(free_s, s0, s1), clip(free_n, n0, n1)), (F.lit(s0), side_n(s0)), (F.lit(s1), side_n(s1)),
                  (side_s(n0), F.lit(n0)), (side_s(n1), F.lit(n1))]
        sse = lambda s, n: syy - 2.0 * n * sy - 2.0 * s * sgy + n * n * m + 2.0 * n * s * sg + s * s * sgg
        t = t.select("point", "range", F.array_min(F.array(*[
            F.struct(F.round(sse(s, n) / syy, 12).alias("loss"), s.alias("sill"), n.alias("nugget"), sse(s, n).alias("sse")) for s, n in points])).alias("b"))
        best = arg_max(t.select("point", "range", "b.*", (-F.col("b.loss")).alias("_gain")), "_gain", "point").select("range", "sill", "nugget", "sse")
        if i < rounds - 1:
            at = best.first()["range"]
            lo, hi = max(first[0], at - width), min(first[1], at + width)
    return best


#: Knots that a chunk of points may meet before it is halved, and knots of a block of the solver.
CHUNK_KNOTS, BLOCK_KNOTS = 2048, 512


def _gram(knots: np.ndarray, points: np.ndarray, a: np.ndarray, v: np.ndarray):
    """Upper half of the Gram matrix of some points' entries as (i, j, value); j = -1 is the right side."""
    ids, col = np.unique(knots, return_inverse=True)
    if len(ids) > CHUNK_KNOTS and points[0] < points[-1]:
        cut = np.searchsorted(points, points[0] + (points[-1] - points[0] + 1) // 2)
        yield from _gram(knots[:cut], points[:cut], a[:cut], v)
        yield from _gram(knots[cut:], points[cut:], a[cut:], v)
        return
    row = points - points[0]
    dense = np.zeros((row[-1] + 1, len(ids)))
    dense[row, col] = a
    gram = np.triu(dense.T @ dense)
    i, j = np.nonzero(gram)
    yield ids[i], ids[j], gram[i, j]
    yield ids, np.full(len(ids), -1), dense.T @ v[points[0]:points[-1] + 1]


def _grams(batches):
    for pdf in batches:
        for start in range(0, len(pdf), 1024):
            part = pdf.iloc[start:start + 1024]
            n = part["j"].str.len().to_numpy(int)
            if n.sum() == 0:
                continue
            for i, j, v in _gram(np.concatenate(part["j"].to_list()), np.repeat(np.arange(len(part)), n), np.concatenate(part["a"].to_list()), part["_v"].to_numpy(float)):
                yield pd.DataFrame({"i": i, "j": j, "v": v})


def normal_equations(df: DataFrame, layers: list[Layer], x: str, y: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Sparse Gram matrix (i, j, v), both halves, and right side (i, b) of the basis; knots are numbered over all layers.

    Points are dealt by ranges of their place first, however many share one, so that a task meets few knots and its
    partial sums, dense products over chunks of near points, are few; what is shuffled then grows with the lattice.
    """
    start = np.cumsum([0] + [l.nx * l.ny for l in layers]).tolist()
    cell = [F.floor((F.col(c) - F.lit(o)) / F.lit(layers[0].width)).cast("long") for c, o in ((x, layers[0].x0), (y, layers[0].y0))]
    near = df.select(x, y, F.col(value).cast("double").alias("_v")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("_v").isNotNull())
    near = near.repartitionByRange(default_buckets(df.sparkSession), *cell, F.xxhash64(x, y, "_v")).sortWithinPartitions(*cell)
    row = near.select("_v", basis_row(layers, x, y).alias("_row")).select(
        "_v", F.transform("_row", lambda e: F.element_at(F.lit(start), e["layer"]) + e["knot"]).cast("array<long>").alias("j"),
        F.transform("_row", lambda e: e["a"]).cast("array<double>").alias("a"))
    sums = cut_lineage(row.mapInPandas(_grams, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")))
    half = sums.where("j >= 0")
    return half.unionByName(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), sums.where("j < 0").select("i", F.col("v").alias("b"))


def basis_ridge(df: DataFrame, layers: list[Layer], lam: float, x: str, y: str, value: str, tolerance: float = 1e-12,
                block_knots: int = BLOCK_KNOTS) -> DataFrame:
    """Ridge coefficients (layer, knot, c) of the multiresolution basis, for every knot near a point.

    Knots without points have the coefficient 0 and no row. The lattice may have any number of knots: the normal
    equations are sparse, and conjugate gradients solve them on Spark. Its blocks are squares that hold at most some
    ``block_knots`` knots of all layers, so that what layers share is solved within a block.
    """
    gram, rhs = normal_equations(df, layers, x, y, value)
    start = np.cumsum([0] + [l.nx * l.ny for l in layers])
    side = math.sqrt(block_knots / sum(l.width**-2 for l in layers))
    x0, y0 = min(l.x0 for l in layers), min(l.y0 for l in layers)
    columns = int(max(l.y0 + l.ny * l.width for l in layers) - y0) // side + 1

    def layer_of(i: Column) -> Column:
        return sum((i >= F.lit(int(s))).cast("int") for s in start[:-1])

    def block(i: Column) -> Column:
        out = F.lit(None).cast("long")
        for l, s in zip(layers, start):
            at = i - F.lit(int(s))
            bx = F.floor((F.lit(l.x0 - x0) + F.floor(at / l.ny) * l.width) / side)
            by = F.floor((F.lit(l.y0 - y0) + at % l.ny * l.width) / side)
            out = F.when(at >= 0, bx * int(columns + 1) + by).otherwise(out)
        return out

    solved = conjugate_gradients(gram, rhs, lam, tolerance, block=block)
    # Written, so that Spark knows their size when entries meet them, dozens for each point.
    return written(solved.select(layer_of(F.col("i")).alias("layer"), "i", F.col("x").alias("c")).select(
        "layer", (F.col("i") - F.element_at(F.lit(start[:-1].tolist()), F.col("layer"))).cast("long").alias("knot"), "c"))
