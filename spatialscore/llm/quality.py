"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics. Each class has a mean and a covariance shrunk towards the
diagonal of the pooled one; the score is the posterior from the difference of Mahalanobis log densities, worked out
with one Cholesky factor per class.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_bytes", "upper", "symbol", "bar", "exclamation", "digit", "stop", "space", "high_byte",
            "word_length", "distinct_words", "repeated_lines", "longest_word")
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text; shares enter as square roots, sizes as logarithms."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    n = max(len(raw), 1)
    words, lines = text.split(), text.split("\n")
    letters = count[65:91].sum() + count[97:123].sum()
    sizes = [len(w) for w in words]
    return np.array([
        np.log1p(len(raw)),
        np.sqrt(count[65:91].sum() / max(letters, 1)),
        np.sqrt(sum(count[c] for c in SYMBOLS) / n),
        np.sqrt(count[ord("|")] / n),
        np.sqrt(count[ord("!")] / n),
        np.sqrt(count[48:58].sum() / n),
        np.sqrt((count[ord(".")] + count[ord(",")]) / n),
        np.sqrt((count[32] + count[9:14].sum()) / n),
        np.sqrt(count[128:].sum() / n),
        np.log1p(sum(sizes) / max(len(words), 1)),
        # The number of distinct words follows a power of the length, so the logarithms are compared.
        np.log1p(len(set(words))) / np.log1p(max(len(words), 1)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(max(sizes, default=0)),
    ])


def features(text: Column) -> Column:
    """array<double> of FEATURES; null counts as empty."""
    def run(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
    return F.arrow_udf(run, "array<double>")(text.cast("string"))


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the inverse covariances and log prior plus half the log determinant."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    fallback: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        logs = [c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, features_col: str = "features", label_col: str = "label", shrinkage: float = 0.1,
        ridge: float = 1e-4) -> Discriminant:
    """Fit on all rows of ``labelled`` whose label is 0 or 1; other labels and null features teach nothing.

    Sums and products are added up on the cluster, so the driver gets two rows of d + d * d numbers. A class of
    fewer than two rows makes the score a constant: the share of label 1, or 0.5 without labels.
    """
    d = len(FEATURES)
    rows = labelled.select(labelled[label_col].cast("int").alias("y"), labelled[features_col].alias("x")).where("y IN (0, 1) AND x IS NOT NULL")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)],
                                 *[F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    held = {r["y"]: r for r in sums}
    counts = [held[y]["n"] if y in held else 0 for y in (0, 1)]
    if min(counts) < 2:
        share = counts[1] / sum(counts) if sum(counts) else 0.5
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), share)
    means, scatter = [], []
    for y in (0, 1):
        r = held[y]
        m = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(m)
        scatter.append(p - np.outer(m, m))
    pooled = sum(c * s for c, s in zip(counts, scatter)) / sum(counts)
    target = np.diag(np.diag(pooled) + ridge)
    factors, constants = [], []
    for s, n in zip(scatter, counts):
        low = np.linalg.cholesky((1 - shrinkage) * s + shrinkage * target)
        factors.append(np.linalg.inv(low).T)
        constants.append(np.log(n) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants))


def score(model: Discriminant, features_col: Column) -> Column:
    """Probability of label 1, from FEATURES; the model's factors go to Python once per task.

    A null array of features counts as zeros. Rows are scored one by one, so repeated rows, empty tables and other
    columns change nothing.
    """
    def run(xs: pa.Array) -> pa.Array:
        # A null array is an empty text's, all zeros.
        rows = [r if r is not None else [0.0] * len(FEATURES) for r in xs.to_pylist()]
        return pa.array(model.score(np.array(rows, dtype=float).reshape(-1, len(FEATURES))), pa.float64())
    return F.arrow_udf(run, "double")(features_col)
