"""Sparse symmetric systems solved on Spark."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Unknowns of a block unless the caller says how to cut them.
BLOCK = 256


def _inverses(batches):
    """Blocks of the diagonal, inverted; directions without weight stay zero, as the right side has none there either."""
    for pdf in batches:
        out = []
        for n, ridge, row, col, v in zip(pdf["n"], pdf["ridge"], pdf["row"], pdf["col"], pdf["v"]):
            a = np.zeros((n, n))
            a[row, col] = v
            a[np.diag_indices(n)] += ridge
            values, vectors = np.linalg.eigh(a)
            keep = values > 1e-14 * max(values[-1], 0.0)
            out.append(((vectors[:, keep] / values[keep]) @ vectors[:, keep].T).tobytes())
        yield pdf[["block", "ids", "b"]].assign(inverse=out)


def _products(batches):
    """Products of the columns of a block with its piece of p, added up for every block of rows they reach."""
    for pdf in batches:
        out = []
        for rows, at, cols, v, p in zip(pdf["row_block"], pdf["row"], pdf["col"], pdf["v"], pdf["p"]):
            w = v * p[cols]
            order = np.lexsort((at, rows))
            rows, at, w = rows[order], at[order], w[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])])
            rows, at, w = rows[new], at[new], np.add.reduceat(w, new)
            cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out += zip(rows[cut].tolist(), np.split(at, cut[1:]), np.split(w, cut[1:]))
        yield pd.DataFrame(out, columns=["block", "at", "w"])


def _steps(batches):
    """w = matrix p and the preconditioned forms z of r and q of w of every block, with its share of the scalar products.

    z is made from r anew each time: carried along beside r it would keep rounding errors as large as the first residual.
    """
    for pdf in batches:
        out = []
        for block, parts, ridge, x, r, p, inverse in zip(*(pdf[c] for c in ("block", "parts", "ridge", "x", "r", "p", "inverse"))):
            w = ridge * p
            for part in (parts if parts is not None else []):
                w[np.asarray(part["at"])] += np.asarray(part["w"])
            m = np.frombuffer(inverse).reshape(len(w), len(w))
            z, q = m @ r, m @ w
            out.append((block, x, r, z, p, w, q, p @ w, r @ r, r @ p, w @ z, w @ q))
        yield pd.DataFrame(out, columns=["block", "x", "r", "z", "p", "w", "q", "pw", "rr", "rp", "wz", "wq"])


def _starts(batches):
    for pdf in batches:
        z = [np.frombuffer(m).reshape(len(b), len(b)) @ b for m, b in zip(pdf["inverse"], pdf["b"])]
        yield pd.DataFrame({"block": pdf["block"], "x": [np.zeros(len(b)) for b in pdf["b"]], "r": pdf["b"], "p": z})


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, ridge: float = 0.0, tolerance: float = 1e-12,
                        most_rounds: int = 10_000, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """(i, x) with (matrix + ridge I) x = rhs, by conjugate gradients preconditioned with the diagonal blocks.

    ``matrix`` (i, j, v) holds both halves of a symmetric positive matrix, ``rhs`` is (i, b) with a row for every unknown.
    ``block`` gives the block of an unknown; blocks should hold some hundred unknowns that depend on each other, however
    many blocks there are (default: runs of 256 numbers). A round joins the vector, one row a block, with the matrix,
    which is laid out by block of columns once, and adds up the products by block of rows: what is shuffled is vectors,
    never entries. Vectors are one table in the checkpoint folder, only sums of their products reach the driver. Ends
    when the residual is below ``tolerance`` times the right side.
    """
    of = block or (lambda i: F.floor(i / BLOCK))
    penalty = F.lit(float(ridge)).alias("ridge")
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    unknowns = rhs.join(diagonal, "i", "left").where(F.coalesce("d", F.lit(0.0)) + penalty > 0).select("i", of(F.col("i")).cast("long").alias("block"), F.col("b").cast("double").alias("b"))
    place = cut_lineage(unknowns.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("i")) - 1))
    side = lambda number, blk, at: place.select(F.col("i").alias(number), F.col("block").alias(blk), F.col("at").alias(at))
    entries = matrix.join(side("i", "row_block", "row"), "i").join(side("j", "block", "col"), "j")
    lists = lambda *cols: [F.col(f"e.{c}").alias(c) for c in cols]
    m = entries.groupBy("block").agg(F.collect_list(F.struct("row_block", "row", "col", "v")).alias("e"))
    m = cut_lineage(m.select("block", *lists("row_block", "row", "col", "v")))

    ids = place.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "i", "b"))).alias("e")).select("block", F.size("e").alias("n"), *lists("i", "b"))
    own = m.select("block", F.filter(F.arrays_zip("row_block", "row", "col", "v"), lambda s: s["row_block"] == F.col("block")).alias("e")).select("block", *lists("row", "col", "v"))
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("row", "array<int>"), ("col", "array<int>"), ("v", "array<double>"))]
    own = ids.withColumnRenamed("i", "ids").join(own, "block", "left").select("block", "ids", "b", "n", penalty, *none)
    pre = cut_lineage(own.mapInPandas(_inverses, "block long, ids array<long>, b array<double>, inverse binary").repartition("block"))

    vectors = lambda names: ", ".join(f"{c} array<double>" for c in names)
    state = pre.select("block", "b", "inverse").mapInPandas(_starts, f"block long, {vectors('xrp')}")
    state = written(state)
    names = ("pw", "rr", "rp", "wz", "wq")
    goal = None
    for _ in range(most_rounds):
        sums = Observation()
        parts = m.join(state.select("block", "p"), "block").select("row_block", "row", "col", "v", "p").mapInPandas(
            _products, "block long, at array<int>, w array<double>")
        parts = parts.groupBy("block").agg(F.collect_list(F.struct("at", "w")).alias("parts"))
        step = state.join(pre.select("block", "inverse"), "block").join(parts, "block", "left").withColumn("ridge", penalty).mapInPandas(
            _steps, f"block long, {vectors('xrzpwq')}, " + ", ".join(f"{c} double" for c in names))
        step = written(step.observe(sums, *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]))
        s = sums.get
        goal = tolerance * math.sqrt(s["rr"]) if goal is None else goal
        if math.sqrt(s["rr"]) <= goal or s["pw"] <= 0:
            solved = pre.select("block", "ids").join(step.select("block", "x"), "block")
            return solved.select(F.inline(F.arrays_zip(F.col("ids").alias("i"), "x")))
        # The best step along p, and the next direction made conjugate to it, whatever rounding did to earlier ones.
        alpha = s["rp"] / s["pw"]
        beta = (alpha * s["wq"] - s["wz"]) / s["pw"]
        plus = lambda a, b, f: F.zip_with(a, b, lambda u, v: u + F.lit(f) * v)
        state = step.select("block", plus("x", "p", alpha).alias("x"), plus("r", "w", -alpha).alias("r"), plus(plus("z", "q", -alpha), "p", beta).alias("p"))
    raise RuntimeError(f"no solution within {most_rounds} rounds")
