"""Group-wise kriging jobs (M1-M6, M12, M13). Only small dense algebra runs inside a task.

Groups that are solved whole are data sets or blocks of checked size; the test rows of a group are
cut into chunks, each with a copy of the group's training rows. Local kriging needs a fixed number of
neighbours per point and has no group at all.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_ppf_const
from ..session import written
from .compare import arg_max
from .ordering import with_portable_hashes
from .posterior import weighted_quantiles_of
from .sampling import equal_parts
from .scoring import gaussian_crps
from .spatial import Choice, nearest_lists, other_folds

MAX_GROUP = 6000   # training rows of one dense solve
MAX_CHUNK = 4000   # test rows of one task
BUNDLE_ROWS = 4000  # rows of the small groups that one call handles together


def exponential(range_: float, sill: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """A covariance is any function of a distance array."""
    return lambda d: sill * np.exp(-d / range_)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += np.subtract.outer(a[:, i], b[:, i]) ** 2
    return np.sqrt(total, out=total)


def conditional_normal(yd, mu_p, mu_d, s_pp_diag, s_dd, s_pd):
    """Mean and sd of the targets given the data."""
    low = np.linalg.cholesky(s_dd)
    both = np.linalg.solve(low, np.column_stack([s_pd.T, yd - mu_d]))
    half = both[:, :-1]
    mean = mu_p + half.T @ both[:, -1]
    return mean, np.sqrt(np.clip(s_pp_diag - (half**2).sum(0), 0.0, None))


def check_group_sizes(df: DataFrame, key: list[str], limit: int = MAX_GROUP) -> int:
    """A dense solve needs its whole group in one task, so larger groups must be cut into blocks first.

    Returns the number of rows of all groups.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.sum("n").alias("rows"), F.max(F.struct("n", *key)).alias("big")).first()
    if r["rows"] and r["big"]["n"] > limit:
        raise ValueError(f"groups above {limit} rows, cut them with bounded_blocks first: {r['big']}")
    return r["rows"] or 0


def _chunked(train: DataFrame, test: DataFrame, key: list[str], chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    parts = test.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_rows))).cast("int").alias("_parts"))
    salted = test.join(parts, key).withColumn(
        "_chunk", F.pmod(F.xxhash64(*test.columns), F.col("_parts")).cast("int")).drop("_parts")
    copies = train.join(parts, key).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # Fresh column identities: both sides may come from the same table.
    return copies.toDF(*copies.columns), salted.toDF(*salted.columns)


def krige_groups(train: DataFrame, test: DataFrame, key: list[str], pid: str, cov: Callable, nugget: float = 0.0,
                 beta: float = 0.0, x: str = "x", y: str = "y", z: str = "z", level: float = 0.8,
                 max_group: int = MAX_GROUP) -> DataFrame:
    """M2: kriging with known covariance per group: ``preds, sigmas, lower, median, upper``.

    Targets of a group without data get the prior mean and sd.
    """
    check_group_sizes(train, key, max_group)
    zq = norm_ppf_const(0.5 + level / 2.0)
    a, b = _chunked(train.select(*key, x, y, z), test.select(*key, pid, x, y), key, MAX_CHUNK)
    schema = b.select(*key, pid).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + \
        ", preds double, sigmas double, lower double, median double, upper double"

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        xs, xp = tr[[x, y]].to_numpy(float), te[[x, y]].to_numpy(float)
        s_dd = cov(_dist(xs, xs)) + nugget * np.eye(len(tr))
        m, s = conditional_normal(tr[z].to_numpy(float), np.full(len(te), beta), np.full(len(tr), beta),
                                  cov(np.zeros(len(te))), s_dd, cov(_dist(xp, xs)))
        return te[[*key, pid]].assign(preds=m, sigmas=s, lower=m - zq * s, median=m, upper=m + zq * s)

    def safe(tr, te):
        if len(te) and len(tr):
            return run(tr, te)
        s = np.sqrt(cov(np.zeros(len(te))))
        return te[[*key, pid]].assign(preds=beta, sigmas=s, lower=beta - zq * s, median=beta, upper=beta + zq * s)

    return a.groupBy(*key, "_chunk").cogroup(b.groupBy(*key, "_chunk")).applyInPandas(safe, out)


def fit_datasets(df: DataFrame, key: str, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                 role: str = "role", max_group: int = MAX_GROUP) -> DataFrame:
    """Run ``fn(train, test)`` on every data set; rows carry ``role`` train or test."""
    check_group_sizes(df, [key], max_group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf[pdf[role] == "train"], pdf[pdf[role] == "test"])

    return df.groupBy(key).applyInPandas(run, schema)


def block_gp_grid(df: DataFrame, block: str, x: str, y: str, z: str, x_cols: list[str], omegas: list[float],
                  alphas: list[float], max_group: int = MAX_GROUP) -> DataFrame:
    """M3: profile log-likelihood of omega exp(-alpha d) + (1 - omega) I over a grid, blocks independent.

    Each block gives X'R^-1X, X'R^-1y, y'R^-1y and log|R| per grid point (a short vector); these are
    summed over blocks on Spark, then beta, sigma^2 and the log-likelihood follow per grid point.
    """
    rows = check_group_sizes(df, [block], max_group)
    p = len(x_cols) + 1
    grid = [(i, float(o), float(a)) for i, (o, a) in enumerate((o, a) for o in omegas for a in alphas)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((len(grid), (p + 1) ** 2 + 2))
        for _, b in pdf.groupby(block, sort=False):
            xy, yv = b[[x, y]].to_numpy(float), b[z].to_numpy(float)
            both = np.column_stack([np.ones(len(b)), *[b[c].to_numpy(float) for c in x_cols], yv])
            d = _dist(xy, xy)
            for i, o, a in grid:
                low = np.linalg.cholesky(o * np.exp(-a * d) + (1.0 - o) * np.eye(len(b)))
                h = np.linalg.solve(low, both)
                total[i, :-2] += (h.T @ h).ravel()
                total[i, -2:] += 2.0 * np.log(np.diag(low)).sum(), len(b)
        return pd.DataFrame([(*g, t.tolist()) for g, t in zip(grid, total)], columns=["point", "omega", "alpha", "stats"])

    need = df.select(block, x, y, z, *[c for c in x_cols if c not in (x, y, z)])
    # Blocks stay whole; many small ones share a call.
    bundles = max(1, -(-rows // BUNDLE_ROWS))
    per = need.groupBy(F.pmod(F.xxhash64(block), F.lit(bundles)).alias("_bundle")).applyInPandas(
        run, "point int, omega double, alpha double, stats array<double>")
    total = per.groupBy("point", "omega", "alpha").agg(
        Summarizer.metrics("sum").summary(array_to_vector("stats")).alias("_s")).select(
        "point", "omega", "alpha", vector_to_array("_s.sum").alias("stats"))

    @F.pandas_udf("beta array<double>, sigma2 double, loglik double")
    def solve(stats: pd.Series) -> pd.DataFrame:
        rows = []
        for s in stats:
            s = np.asarray(s)
            m, logdet, n = s[:-2].reshape(p + 1, p + 1), s[-2], s[-1]
            b = np.linalg.solve(m[:p, :p], m[:p, p])
            ss = m[p, p] - b @ m[:p, p]
            sig2 = ss / (n - p)
            rows.append((b.tolist(), sig2, -(n / 2) * np.log(sig2) - 0.5 * logdet - 0.5 * ss / sig2))
        return pd.DataFrame(rows, columns=["beta", "sigma2", "loglik"])

    return total.withColumn("_r", solve("stats")).select("point", "omega", "alpha", "_r.*")


def best_grid_point(grid: DataFrame) -> DataFrame:
    """Largest log-likelihood, first on ties."""
    return arg_max(grid, "loglik", "point")


def block_predict(train: DataFrame, test: DataFrame, block: str, pid: str, x: str, y: str, z: str, x_cols: list[str],
                  params: dict, max_group: int = MAX_GROUP) -> DataFrame:
    """M4: prediction in each block with the chosen parameters: ``pred, sd, lower, upper``."""
    check_group_sizes(train, [block], max_group)
    o, al, s2, beta = params["omega"], params["alpha"], params["sigma2"], np.asarray(params["beta"])
    extra = [c for c in x_cols if c not in (x, y)]
    a, b = _chunked(train.select(block, x, y, z, *extra), test.select(block, pid, x, y, *extra), [block], MAX_CHUNK)
    z975 = norm_ppf_const(0.975)
    kind = b.schema[pid].dataType.simpleString()

    def mean(pdf):
        return np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in x_cols]]) @ beta

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        if len(te) == 0:
            return pd.DataFrame({block: [], pid: [], "pred": [], "sd": [], "lower": [], "upper": []})
        xp, m = te[[x, y]].to_numpy(float), mean(te)
        if len(tr) == 0:
            s = np.full(len(te), np.sqrt(s2))
        else:
            xs = tr[[x, y]].to_numpy(float)
            m, s = conditional_normal(tr[z].to_numpy(float), m, mean(tr), np.ones(len(te)),
                                      o * np.exp(-al * _dist(xs, xs)) + (1 - o) * np.eye(len(tr)),
                                      o * np.exp(-al * _dist(xp, xs)))
            s = s * np.sqrt(s2)
        return te[[block, pid]].assign(pred=m, sd=s, lower=m - z975 * s, upper=m + z975 * s)

    return a.groupBy(block, "_chunk").cogroup(b.groupBy(block, "_chunk")).applyInPandas(
        run, f"`{block}` {b.schema[block].dataType.simpleString()}, `{pid}` {kind}, pred double, sd double, lower double, upper double")


# --- local kriging --------------------------------------------------------------------------------

def neighbour_rows(train: DataFrame, test: DataFrame, pid: str, rid: str, x: str, y: str, z: str, k: int,
                   group: list[str] = (), choice: Choice | None = None, own: list[str] = ()) -> DataFrame:
    """One row per test point with arrays of its k neighbours' distance, place and value; ``own`` names columns that stay."""
    near = nearest_lists(test, train, pid, rid, px=x, py=y, rx=x, ry=y, k=k, group=group, carry=[x, y, z], choice=choice, own=own, ids=False)
    return near.select(pid, *[g for g in group if g != pid], *own, F.col("_d").alias("nb_d"), *[F.col(f"_c_{c}").alias(f"nb_{n}") for c, n in ((x, "x"), (y, "y"), (z, "z"))])


def _pad(col: pd.Series, k: int) -> np.ndarray:
    out = np.full((len(col), k), np.nan)
    for i, v in enumerate(col):
        out[i, :len(v)] = v
    return out


def solve_neighbours(nb: DataFrame, params: list[dict], cov_of: Callable = None) -> DataFrame:
    """k x k solves in batches for every parameter set; adds ``param, pred, sd``.

    A parameter set has ``range, sill, nugget`` and optionally ``mean``.
    """
    cov_of = cov_of or (lambda p: exponential(p["range"], p["sill"]))
    keep = [c for c in nb.columns if not c.startswith("nb_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nb.select(*keep).schema) + \
        ", param int, pred double, sd double"

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            k = int(pdf["nb_d"].map(len).max())
            d, xs, ys, zs = (_pad(pdf[f"nb_{c}"], k) for c in ("d", "x", "y", "z"))
            miss = np.isnan(d)
            dist = np.sqrt((xs[:, :, None] - xs[:, None, :]) ** 2 + (ys[:, :, None] - ys[:, None, :]) ** 2)
            gone = miss[:, :, None] | miss[:, None, :]
            eye = np.eye(k)[None]
            for i, p in enumerate(params):
                cov, mu = cov_of(p), p.get("mean", 0.0)
                s = np.where(gone, 0.0, cov(np.where(gone, 0.0, dist))) + eye * (p["nugget"] + np.where(miss, 1.0, 0.0)[:, :, None])
                c = np.where(miss, 0.0, cov(np.where(miss, 0.0, d)))
                w = np.linalg.solve(s, c[:, :, None])[:, :, 0]
                pred = mu + (w * np.where(miss, 0.0, zs - mu)).sum(1)
                var = float(cov(np.zeros(1))[0]) + p["nugget"] - (w * c).sum(1)
                yield pdf[keep].assign(param=i, pred=pred, sd=np.sqrt(np.clip(var, 0.0, None)))

    return nb.mapInPandas(run, schema)


def local_krige(train: DataFrame, test: DataFrame, pid: str, rid: str, params: dict, x: str = "east", y: str = "north",
                z: str = "truth", k: int = 15, group: list[str] = ()) -> DataFrame:
    """M5: kriging of every test point from its k nearest training points."""
    return solve_neighbours(neighbour_rows(train, test, pid, rid, x, y, z, k, group), [params]).drop("param")


def left_out_neighbours(df: DataFrame, pid: str, fold: str, n_folds: int, x: str, y: str, z: str, k: int, own: list[str] = ()) -> DataFrame:
    """Neighbours of every row of folds 1 to ``n_folds`` among the rows of all other folds, which are summarised once."""
    # Stored, as references and points are both read more than once.
    rows = written(df.where(F.col(fold).isNotNull()).select(*dict.fromkeys([pid, x, y, z, *own]), F.col(fold).cast("int").alias("_of")))
    left_out = rows.where(F.col("_of").between(1, n_folds)).withColumnRenamed("_of", "_fold")
    return neighbour_rows(rows, left_out, pid, pid, x, y, z, k, choice=other_folds(list(range(1, n_folds + 1))), own=own)


def grid_cv(df: DataFrame, pid: str, fold: str, n_folds: int, params: list[dict], x: str = "east", y: str = "north",
            z: str = "truth", k: int = 15) -> DataFrame:
    """M6: mean cross-validated CRPS of every parameter set; neighbours are found once for the whole grid."""
    # The truth stays with the points, so their neighbours' arrays meet no table.
    nb = left_out_neighbours(df.withColumn("_y", F.col(z)), pid, fold, n_folds, x, y, z, k, own=["_y"])
    p = solve_neighbours(nb, params)
    # Stored: worked out again, sums in another order would differ in their last digits from those that a caller compares.
    return written(p.groupBy("param").agg(F.avg(gaussian_crps("_y", "pred", "sd")).alias("crps"), F.count(F.lit(1)).alias("n")))


def cross_validate(df: DataFrame, pid: str, fold: str, n_folds: int, models: dict[str, dict], x: str = "east",
                   y: str = "north", z: str = "truth", k: int = 15) -> DataFrame:
    """Left-out predictions of every model, ready for the scoring operators."""
    # The columns stay with the points, so predictions, one for each model, meet no table.
    nb = left_out_neighbours(df, pid, fold, n_folds, x, y, z, k, own=[c for c in df.columns if c != pid])
    names = list(models)
    p = solve_neighbours(nb, [models[m] for m in names])
    label = F.element_at(F.array(*[F.lit(m) for m in names]), F.col("param") + 1)
    return p.withColumn("model", label).drop("param")


def subset_combine(train: DataFrame, test: DataFrame, pid: str, rid: str, n_subsets: int, params: dict,
                   weights: list[float] | None = None, x: str = "east", y: str = "north", z: str = "truth",
                   k: int = 15, n_draws: int = 20, seed: int = 0) -> DataFrame:
    """An independent fit per random subset, normal draws from each, weighted quantiles of the pool."""
    weights = weights or [1.0 / n_subsets] * n_subsets
    parts = written(equal_parts(train.select(*dict.fromkeys([rid, x, y, z])), rid, n_subsets, seed))
    every = test.select(*dict.fromkeys([pid, x, y]), F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))).alias("subset"))
    fit = local_krige(parts, every, pid, rid, params, x, y, z, k, ["subset"])
    # Repeatable uniforms from the row key, turned normal by Box-Muller. The fits of a point meet before they are drawn
    # from, so draws stay in its row.
    draws = range(1, n_draws + 1)
    hashed = with_portable_hashes(fit.repartition(pid), {f"_u{i}_{salt}": F.xxhash64(pid, "subset", F.lit(i), F.lit(salt)) for i in draws for salt in (1, 2)}, seed)
    u = lambda i, salt: (F.col(f"_u{i}_{salt}") + 0.5) / F.lit(4294967296.0)
    normal = lambda i: F.sqrt(F.lit(-2.0) * F.ln(u(i, 1))) * F.cos(F.lit(2.0 * np.pi) * u(i, 2))
    drawn = hashed.select(pid, "subset", F.array(*[F.col("pred") + F.col("sd") * normal(i) for i in draws]).alias("_v"))
    w = F.array(*[F.lit(float(v) / n_draws) for v in weights])
    atoms = F.transform("_v", lambda v, i: F.struct(v.alias("value"), (F.col("subset") * n_draws + i + 1).alias("tie"), F.element_at(w, F.col("subset") + 1).alias("weight")))
    pooled = drawn.select(pid, atoms.alias("_atoms")).groupBy(pid).agg(F.flatten(F.collect_list("_atoms")).alias("_atoms"))
    return weighted_quantiles_of(pooled, [pid], "_atoms", {"q_lower": 0.025, "q50": 0.5, "q_upper": 0.975})
