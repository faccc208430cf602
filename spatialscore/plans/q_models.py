"""Queries for group-wise fits, trends, variogram fits and file streams (M, R, X1, X2)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import kriging as Kr
from ..operators import scoring as Sc
from ..operators import strata as St
from ..operators import trend as Tr
from ..operators.filters import in_box, on_day_of_year, quality_ok
from ..operators.lattice import basis_entries, sparse_apply
from ..operators.sampling import equal_parts, stratified_folds
from ..operators.spatial import bounded_blocks, directional_variogram, stratified_nearest, variogram
from ..streaming.scores import ingest_stream, running_binned_scores
from . import views as V
from .q_areas import DIRECTED, SQUARE
from .q_joins import ENTRIES, LAYERS
from .q_scans import scratch
from .registry import query

PARAMS = {"range": 5.0, "sill": 15000.0, "nugget": 5000.0, "mean": 250.0}
SET_SIZE = 400


def data_sets(spark, sf):
    """Many data sets of bounded size: consecutive orders, each with train and test rows."""
    return V.points(spark, sf).select(
        F.floor(F.col("id") / SET_SIZE).alias("dataset_id"), "id", "role", F.col("east").alias("x"), F.col("north").alias("y"),
        (F.col("truth") - 250.0).alias("z"))


def fit_exponential(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
    """A user-given model: picks the range with the largest likelihood, then predicts."""
    cols = ["dataset_id", "id", "pred", "lower", "upper", "range"]
    if len(train) == 0 or len(test) == 0:
        return test[["dataset_id", "id"]].assign(pred=np.nan, lower=np.nan, upper=np.nan, range=np.nan)[cols]
    xs, ys = train[["x", "y"]].to_numpy(float), train["z"].to_numpy(float)
    d, var = Kr._dist(xs, xs), ys.var() + 1e-9
    best = None
    for r in (1.0, 3.0, 9.0):
        s = 0.7 * var * np.exp(-d / r) + 0.3 * var * np.eye(len(ys))
        low = np.linalg.cholesky(s)
        h = np.linalg.solve(low, ys - ys.mean())
        loglik = -np.log(np.diag(low)).sum() - 0.5 * h @ h
        if best is None or loglik > best[0]:
            best = (loglik, r, s)
    c = 0.7 * var * np.exp(-Kr._dist(test[["x", "y"]].to_numpy(float), xs) / best[1])
    m, s = Kr.conditional_normal(ys, np.full(len(test), ys.mean()), np.full(len(ys), ys.mean()), np.full(len(test), var), best[2], c)
    return pd.DataFrame({"dataset_id": test["dataset_id"], "id": test["id"], "pred": m, "lower": m - 1.2816 * s, "upper": m + 1.2816 * s, "range": best[1]})[cols]


FIT_SCHEMA = "dataset_id long, id long, pred double, lower double, upper double, range double"


@query("m01_fit_data_sets")
def _(spark, sf):
    return Kr.fit_datasets(data_sets(spark, sf), "dataset_id", fit_exponential, FIT_SCHEMA)


@query("m01_mean_parameters")
def _(spark, sf):
    f = Kr.fit_datasets(data_sets(spark, sf), "dataset_id", fit_exponential, FIT_SCHEMA)
    per = f.groupBy("dataset_id").agg(F.max("range").alias("range"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("range").alias("mean_range"), F.stddev_samp("range").alias("sd_range"))


@query("m02_group_kriging")
def _(spark, sf):
    d = data_sets(spark, sf)
    return Kr.krige_groups(d.where("role = 'train'"), d.where("role = 'test'"), ["dataset_id"], "id",
                           Kr.exponential(5.0, 15000.0), nugget=5000.0)


def blocks(spark, sf):
    return bounded_blocks(V.points(spark, sf), "east", "north", "id", 300)


OMEGAS, ALPHAS = [0.2, 0.5, 0.8], [0.1, 0.3, 1.0]


@query("m03_block_likelihood")
def _(spark, sf):
    g = Kr.block_gp_grid(blocks(spark, sf), "block", "east", "north", "truth", ["east", "north"], OMEGAS, ALPHAS)
    return g.select("point", "omega", "alpha", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"), F.col("beta")[2].alias("b2"), "sigma2", "loglik")


@query("m04_block_prediction")
def _(spark, sf):
    b = blocks(spark, sf)
    train = b.where("role = 'train'")
    best = Kr.best_grid_point(Kr.block_gp_grid(train, "block", "east", "north", "truth", ["east", "north"], OMEGAS, ALPHAS)).first()
    return Kr.block_predict(train, b.where("role = 'test'"), "block", "id", "east", "north", "truth", ["east", "north"], best.asDict())


def split(spark, sf):
    p = V.points(spark, sf)
    return p.where("role = 'train'"), p.where("role = 'test'")


@query("m05_local_kriging")
def _(spark, sf):
    train, test = split(spark, sf)
    return Kr.local_krige(train, test, "id", "id", PARAMS)


@query("m06_grid_cross_validation")
def _(spark, sf):
    folds = equal_parts(V.points(spark, sf), "id", 5, 3).withColumn("fold", F.col("subset") + 1)
    grid = [{"range": r, "sill": 15000.0, "nugget": n, "mean": 250.0} for r in (1.0, 3.0, 5.0, 7.0, 9.0) for n in (100.0, 2000.0, 5000.0, 8000.0, 12000.0)]
    cv = Kr.grid_cv(folds, "id", "fold", 5, grid)
    label = F.array(*[F.struct(F.lit(g["range"]).alias("range"), F.lit(g["nugget"]).alias("nugget")) for g in grid])
    return cv.select("param", F.get(label, F.col("param")).alias("g"), "crps", "n").select(
        "param", "g.*", "crps", "n", (F.col("crps") == cv.select(F.min("crps")).scalar()).alias("best"))


TREND = """
    t0 AS (SELECT id, truth AS y, east AS x1, north AS x2, east * north AS x3 FROM points),
    s1 AS (SELECT regr_slope(x2, x1) AS a, regr_slope(x3, x1) AS b FROM t0),
    t1 AS (SELECT id, y, x1, x2 - a * x1 AS z2, x3 - b * x1 AS w3, a, b FROM t0, s1),
    s2 AS (SELECT regr_slope(w3, z2) AS c FROM t1),
    t2 AS (SELECT id, y, x1, z2, w3 - c * z2 AS z3, a, b, c FROM t1, s2),
    s3 AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(z2) AS m2, avg(z3) AS m3, regr_slope(y, x1) AS g1, regr_slope(y, z2) AS g2, regr_slope(y, z3) AS g3,
      any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, var_pop(y) AS vy FROM t2),
    fit AS (SELECT id, y, my + g1 * (x1 - m1) + g2 * (z2 - m2) + g3 * (z3 - m3) AS fitted FROM t2, s3)"""


@query("m07_trend_fit", "points", "SELECT id, fitted, y - fitted AS residual FROM fit", rnd="fitted residual", ctes=TREND)
def _(spark, sf):
    d = Tr.detrend(V.points(spark, sf), "truth", Tr.product_terms(["east", "north"]))
    return d.select("id", "fitted", "residual")


@query("m07_trend_r2", "points", "SELECT count(*) AS n, 1 - avg((y - fitted) * (y - fitted)) / any_value(vy) AS r2 FROM fit, s3", rnd="r2", ctes=TREND)
def _(spark, sf):
    p = V.points(spark, sf)
    t = Tr.ols(p, "truth", Tr.product_terms(["east", "north"]))
    return p.agg(F.count(F.lit(1)).alias("n")).withColumn("r2", F.lit(t.r2))


@query("m08_surface_from_coefficients", "points grid", """
    SELECT ix, iy, my + g1 * (x1 - m1) + g2 * ((x2 - a * x1) - m2) + g3 * ((x3 - b * x1 - c * (x2 - a * x1)) - m3) AS surface
    FROM (SELECT ix, iy, CAST(ix AS DOUBLE) AS x1, iy / 2e0 AS x2, ix * (iy / 2e0) AS x3 FROM grid), s3""", rnd="surface", ctes=TREND)
def _(spark, sf):
    terms = Tr.product_terms(["east", "north"])
    t = Tr.ols(V.points(spark, sf), "truth", terms)
    g = V.grid(spark, sf).withColumns({"east": F.col("ix").cast("double"), "north": F.col("iy") / 2.0})
    return g.select("ix", "iy", t.fitted().alias("surface"))


@query("m09_detrended_residuals", "points", """
    SELECT region, count(*) AS n, avg(y - fitted) AS mean_residual, stddev_samp(y - fitted) AS sd_residual FROM fit JOIN
      (SELECT o_orderkey AS id, o_orderpriority AS region FROM orders) USING (id) GROUP BY region""", rnd="mean_residual sd_residual", ctes=TREND)
def _(spark, sf):
    d = Tr.detrend(V.points(spark, sf), "truth", Tr.product_terms(["east", "north"]))
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("region"))
    return d.join(o, "id").groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"), F.stddev_samp("residual").alias("sd_residual"))


BOUNDS = {"range": (0.25, 6.0), "sill": (500.0, 30000.0), "nugget": (0.0, 30000.0)}


def _fit_sql() -> str:
    (r0, r1), (s0, s1), (n0, n1) = (tuple(f"{v!r}::DOUBLE" for v in BOUNDS[k]) for k in ("range", "sill", "nugget"))
    parts = []
    for r in range(3):
        lo = r0 if r == 0 else f"greatest({r0}, b{r}.range - b{r}.w)"
        hi = r1 if r == 0 else f"least({r1}, b{r}.range + b{r}.w)"
        parts.append(f"""g{r + 1} AS (SELECT p, lo + p * ((hi - lo) / 63) AS range, (hi - lo) / 63 AS w FROM range(64) t(p), (SELECT {lo} AS lo, {hi} AS hi {'' if r == 0 else f'FROM b{r}'})),
          t{r + 1} AS (SELECT p, range, w, CAST(count(*) AS DOUBLE) AS m, sum(g) AS sg, sum(g * g) AS sgg, sum(gamma) AS sy, sum(g * gamma) AS sgy, sum(gamma * gamma) AS syy
            FROM (SELECT p, range, w, gamma, 1 - exp(-h / range) AS g FROM g{r + 1}, directed) GROUP BY p, range, w),
          f{r + 1} AS (SELECT *, (m * sgy - sg * sy) / (m * sgg - sg * sg) AS fs FROM t{r + 1}),
          c{r + 1} AS (SELECT *, least(greatest(fs, {s0}), {s1}) AS sill, least(greatest((sy - fs * sg) / m, {n0}), {n1}) AS nugget FROM f{r + 1}
            UNION ALL SELECT *, {s0}, least(greatest((sy - {s0} * sg) / m, {n0}), {n1}) FROM f{r + 1}
            UNION ALL SELECT *, {s1}, least(greatest((sy - {s1} * sg) / m, {n0}), {n1}) FROM f{r + 1}
            UNION ALL SELECT *, least(greatest((sgy - {n0} * sg) / sgg, {s0}), {s1}), {n0} FROM f{r + 1}
            UNION ALL SELECT *, least(greatest((sgy - {n1} * sg) / sgg, {s0}), {s1}), {n1} FROM f{r + 1}),
          b{r + 1} AS (SELECT range, w, sill, nugget, (syy - 2 * nugget * sy - 2 * sill * sgy + nugget * nugget * m + 2 * nugget * sill * sg + sill * sill * sgg) AS sse
            FROM c{r + 1} ORDER BY round(sse / syy, 12), p, sill, nugget LIMIT 1)""")
    return DIRECTED + ", " + ", ".join(parts)


@query("m10_variogram_fit", "grid", "SELECT range, sill, nugget, round(sse, 0) AS sse FROM b3", rnd="range sill nugget sse", ctes=_fit_sql(), digits=3)
def _(spark, sf):
    vg = directional_variogram(variogram(V.grid(spark, sf), SQUARE), 8, 8, 0.5, 0.8)
    return Tr.variogram_fit(vg.select("h", "gamma"), BOUNDS).withColumn("sse", F.round("sse", 0))


def basis_fit(spark, sf):
    """Points with z, and the ridge coefficients of the training points (penalty 1)."""
    p = V.points(spark, sf).withColumn("z", F.col("truth") - 250.0)
    return p, Tr.basis_ridge(p.where("role = 'train'"), LAYERS, 1.0, "east", "north", "z")


@query("m11_basis_regression")
def _(spark, sf):
    p, coef = basis_fit(spark, sf)
    test = p.where("role = 'test'")
    pred = sparse_apply(basis_entries(test, LAYERS, "id", "east", "north"), coef, "id", points=test)
    return pred.select("id", (F.col("value") + 250.0).alias("pred"))


@query("m11_normal_equations", "points", """
    SELECT layer, knot, sum(a * (truth - 250)) AS rhs FROM entries JOIN points USING (id) WHERE role = 'train' GROUP BY layer, knot HAVING max(a) > 1e-6""",
       rnd="rhs", ints="layer", ctes=ENTRIES, digits=1)
def _(spark, sf):
    # The solved coefficients, put back through the basis and its transpose, must give the right side at every knot.
    p, coef = basis_fit(spark, sf)
    # Fitted values join the points, not their entries, whose number the planner does not know and which it may broadcast.
    train = p.where("role = 'train'")
    fitted = sparse_apply(basis_entries(train, LAYERS, "id", "east", "north"), coef, "id")
    e = basis_entries(train.join(fitted, "id"), LAYERS, "id", "east", "north", ["value"])
    back = e.groupBy("layer", "knot").agg(F.sum(F.col("a") * F.col("value")).alias("v"), F.max("a").alias("top"))
    return back.where("top > 1e-6").join(coef, ["layer", "knot"]).select("layer", "knot", (F.col("v") + F.col("c")).alias("rhs"))


def validation(spark, sf):
    """Left-out predictions of two models for 8 stratified folds."""
    folds = stratified_folds(V.obs(spark, sf).select("id", "county", "region", "urban", "east", "north", "truth"), ["county", "urban"], "id")
    models = {"short": {**PARAMS, "range": 1.0}, "long": {**PARAMS, "range": 6.0}}
    p = Kr.cross_validate(folds, "id", "fold", 8, models)
    return Sc.single_scores(p, truth="truth", est="pred", sd="sd")


@query("m12_cross_validation")
def _(spark, sf):
    s = validation(spark, sf)
    return St.mean_over_folds(St.scores_by_subset(s, ["model", "fold"]), ["model", "subset"], ["bias", "mse", "rmse", "crps", "interval_score", "coverage", "width"])


@query("m12_validation_by_distance")
def _(spark, sf):
    s = validation(spark, sf)
    nn = stratified_nearest(V.points(spark, sf), V.points(spark, sf), "id", "id").drop("urban")
    return St.scores_by_even_distance(s.join(nn, "id"), "nn_all", 10, ["model"])


@query("m13_subset_posterior")
def _(spark, sf):
    train, test = split(spark, sf)
    return Kr.subset_combine(train, test, "id", "id", 6, PARAMS, weights=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1])


def fit_mean(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
    """The smallest user-given model: the training mean and its spread."""
    m, s = (train["z"].mean(), train["z"].std()) if len(train) else (np.nan, np.nan)
    return test[["dataset_id", "id"]].assign(pred=m, sigma=s)


@query("x01_pluggable_fit", "points", """
    SELECT id // 400 AS dataset_id, id, m AS pred, s AS sigma FROM points JOIN
      (SELECT id // 400 AS d, avg(truth - 250) AS m, stddev_samp(truth - 250) AS s FROM points WHERE role = 'train' GROUP BY 1) ON d = id // 400
    WHERE role = 'test'""", rnd="pred sigma")
def _(spark, sf):
    return Kr.fit_datasets(data_sets(spark, sf), "dataset_id", fit_mean, "dataset_id long, id long, pred double, sigma double")


@query("x02_pluggable_covariance")
def _(spark, sf):
    # Any function of distance serves as covariance; here Matern with smoothness 3/2.
    matern = lambda p: (lambda d: p["sill"] * (1.0 + np.sqrt(3.0) * d / p["range"]) * np.exp(-np.sqrt(3.0) * d / p["range"]))
    train, test = split(spark, sf)
    nb = Kr.neighbour_rows(train, test, "id", "id", "east", "north", "truth", 8)
    return Kr.solve_neighbours(nb, [PARAMS], matern).drop("param")


# --- file streams ---------------------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@query("r01_stream_ingest", sql="""
    SELECT event_id, event_type, value FROM events WHERE event_id % 4 - 1 <= 1 AND dayofyear(ts) = 12 AND value BETWEEN 10 AND 90""", rnd="value")
def _(spark, sf):
    rules = [quality_ok(F.col("event_id") % 4 - 1, "at_most_good"), on_day_of_year("ts", 12), in_box("value", "value", (10, 90), (10, 90))]
    stream = ingest_stream(spark, sf, EVENT_SCHEMA, rules, name_filter="events.parquet")
    out = scratch(spark, "ingest")
    q = (stream.select("event_id", "event_type", "value").writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("event_id bigint, event_type string, value double").parquet(f"{out}/data")


@query("r02_running_binned_scores", "swath", """
    SELECT date_trunc('day', ts) AS day, model, bin, count(*) AS n, avg(value) AS value, avg(value * value) AS sq FROM swath GROUP BY 1, 2, 3""",
       rnd="value sq", digits=9)
def _(spark, sf):
    stream = ingest_stream(spark, sf, EVENT_SCHEMA, [], name_filter="events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("bin"), "value",
        (F.col("value") * F.col("value")).alias("sq"))
    agg = running_binned_scores(stream, "ts", "2 days", "1 day", ["model", "bin"], ["value", "sq"])
    out = scratch(spark, "running")

    def upsert(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{out}/data")

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # The last state of a key is its result; earlier batches hold its partial states.
    rows = spark.read.parquet(f"{out}/data")
    latest = rows.groupBy("day", "model", "bin").agg(F.max_by(F.struct("n", "value", "sq"), "batch").alias("s"))
    return latest.select(F.col("day").cast("timestamp_ntz").alias("day"), "model", "bin", "s.*")
