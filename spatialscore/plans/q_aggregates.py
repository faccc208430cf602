"""Queries for scores, pooled, stratified and binned (A, B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws as Dr
from ..functions.normal import norm_cdf_sql
from ..operators import scoring as Sc
from ..operators import strata as St
from ..operators.compare import flag_best_worst, pair_models
from ..operators.ordering import group_quantiles
from ..operators.posterior import add_noise, noise_ctes, uniform_sql
from ..operators.spatial import stratified_nearest
from . import views as V
from .registry import query

EIGHT = """avg(err) AS bias, var_pop(err) AS var, avg(sq_err) AS mse, sqrt(avg(sq_err)) AS rmse, avg(crps) AS crps,
    avg(interval_score) AS interval_score, avg(coverage) AS coverage, avg(width) AS width"""
EIGHT_R = "bias var mse rmse crps interval_score coverage width"


@query("a01_mean_errors", "single", "SELECT model, avg(err) AS bias, var_pop(err) AS var, avg(sq_err) AS mse, sqrt(avg(sq_err)) AS rmse FROM single GROUP BY model",
       rnd="bias var mse rmse")
def _(spark, sf):
    return Sc.score_agg(V.preds(spark, sf), ["model"], truth="truth", est="est", sd="sd").select("model", "bias", "var", "mse", "rmse")


@query("a02_weighted_errors", "preds", """
    SELECT model, b AS bias, m AS mse, m - b * b AS var FROM (SELECT model, sum(w * r) / sum(w) AS b, sum(w * r * r) / sum(w) AS m
      FROM (SELECT model, CAST(1 + id % 5 AS DOUBLE) AS w, est - truth AS r FROM preds) GROUP BY model)""", rnd="bias mse var")
def _(spark, sf):
    return Sc.weighted_mse(V.preds(spark, sf).withColumn("w", (1 + F.col("id") % 5).cast("double")), ["model"], "truth", "est", "w")


@query("a03_mean_absolute_error", "single", "SELECT model, region, avg(abs_err) AS mae FROM single GROUP BY model, region", rnd="mae")
def _(spark, sf):
    return V.single(spark, sf).groupBy("model", "region").agg(F.avg("abs_err").alias("mae"))


@query("a04_gaussian_crps", "single", "SELECT id, model, crps FROM single", rnd="crps")
def _(spark, sf):
    return V.single(spark, sf).select("id", "model", "crps")


ENSEMBLE = """
    ens AS (SELECT vec_id, any_value(area) AS area, any_value(truth) AS truth, avg(v) AS est,
        avg(abs(v - truth)) - sum((2 * r - m - 1) * v) / any_value(m * m) AS crps, quantile_cont(v, 0.1::DOUBLE) AS lo, quantile_cont(v, 0.9::DOUBLE) AS hi
      FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS r, count(*) OVER (PARTITION BY vec_id) AS m FROM long_draws) GROUP BY vec_id)"""


@query("a05_ensemble_crps", "long_draws", "SELECT vec_id, crps FROM ens", rnd="crps", ctes=ENSEMBLE)
def _(spark, sf):
    d = Dr.with_draw_stats(V.draws(spark, sf), "draws")
    return d.select("vec_id", Dr.ensemble_crps("_sorted", "truth").alias("crps"))


@query("a06_interval_score", "single", "SELECT id, model, interval_score FROM single", rnd="interval_score")
def _(spark, sf):
    return V.single(spark, sf).select("id", "model", "interval_score")


@query("a07_coverage_and_width", "single", "SELECT model, county, avg(coverage) AS coverage, avg(width) AS width FROM single GROUP BY model, county",
       rnd="coverage width")
def _(spark, sf):
    return V.single(spark, sf).groupBy("model", "county").agg(F.avg("coverage").alias("coverage"), F.avg("width").alias("width"))


def _fuzzy_sql(keys: str, rows: str, delta: str) -> str:
    """Fuzzy scores for each of ``keys`` of rows (keys, truth, v): everything that follows from the two limits."""
    return f"""
    SELECT *, truth_error * truth_error AS sq_err, least(inside, 1 - coalesce(p_lo, 0), 1 - coalesce(p_hi, 0)) AS coverage,
      hi - lo - coalesce(delta * p_lo, 0) - coalesce(delta * p_hi, 0) AS width,
      hi - lo - coalesce(delta * p_lo, 0) - coalesce(delta * p_hi, 0) + CASE WHEN truth < lo THEN 10 * (lo - truth) ELSE 0 END
        + CASE WHEN truth > hi THEN 10 * (truth - hi) ELSE 0 END AS interval_score
    FROM (SELECT *, mean - truth AS truth_error, CASE WHEN lo <= truth AND truth <= hi THEN 1e0 ELSE 0e0 END AS inside,
        CASE WHEN lo = truth THEN (0.1::DOUBLE - below) / at_lo END AS p_lo, CASE WHEN hi = truth THEN (0.1::DOUBLE - above) / at_hi END AS p_hi
      FROM (SELECT {keys}, any_value(truth) AS truth, any_value(lo) AS lo, any_value(hi) AS hi, avg(CAST(v < lo AS INT)) AS below,
          avg(CAST(v = lo AS INT)) AS at_lo, avg(CAST(v > hi AS INT)) AS above, avg(CAST(v = hi AS INT)) AS at_hi, {delta} AS delta,
          avg(v) AS mean, avg(abs(v - truth)) - sum((2 * r - m - 1) * v) / any_value(m * m) AS crps
        FROM (SELECT *, quantile_cont(v, 0.1::DOUBLE) OVER (PARTITION BY {keys}) AS lo, quantile_cont(v, 0.9::DOUBLE) OVER (PARTITION BY {keys}) AS hi,
            v - lag(v) OVER (PARTITION BY {keys} ORDER BY v) AS gap, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS r, count(*) OVER (PARTITION BY {keys}) AS m FROM ({rows}))
        GROUP BY {keys}))"""


FUZZY_ROWS = "SELECT vec_id, truth, unnest(draws) AS v FROM counts"


@query("a08_fuzzy_coverage", "counts", f"SELECT vec_id, coverage, width, interval_score FROM ({_fuzzy_sql('vec_id', FUZZY_ROWS, 'min(nullif(gap, 0))')})",
       rnd="coverage width interval_score")
def _(spark, sf):
    s = Sc.single_scores(V.counts(spark, sf), truth="truth", draws="draws", fuzzy=True)
    return s.select("vec_id", "coverage", "width", "interval_score")


@query("a08_fuzzy_coverage_of_trials", "counts", f"SELECT vec_id, coverage, width, interval_score FROM ({_fuzzy_sql('vec_id', FUZZY_ROWS, '1e0 / (5 + vec_id % 20)')})",
       rnd="coverage width interval_score")
def _(spark, sf):
    # The step between possible values is one trial's share, whatever values were drawn.
    rows = V.counts(spark, sf).withColumn("trials", 5 + F.col("vec_id") % 20)
    s = Sc.single_scores(rows, truth="truth", draws="draws", fuzzy=True, sizes="trials")
    return s.select("vec_id", "coverage", "width", "interval_score")


@query("a09_interval_sources", "preds long_draws", f"""
    SELECT 'gaussian' AS source, id AS key, est - {V.Z80} * sd AS lower, est + {V.Z80} * sd AS upper FROM preds
    UNION ALL SELECT 'given', id, least(est + sd, est - 2 * sd + id % 100), greatest(est + sd, est - 2 * sd + id % 100) FROM preds
    UNION ALL SELECT 'draws', vec_id, quantile_cont(v, 0.1::DOUBLE), quantile_cont(v, 0.9::DOUBLE) FROM long_draws GROUP BY vec_id""", rnd="lower upper")
def _(spark, sf):
    p = V.preds(spark, sf)
    g = Sc.with_interval(p, est="est", sd="sd").select(F.lit("gaussian").alias("source"), F.col("id").alias("key"), "_lower", "_upper")
    lim = p.withColumns({"a": F.col("est") + F.col("sd"), "b": F.col("est") - 2 * F.col("sd") + F.col("id") % 100})
    u = Sc.with_interval(lim, lower="a", upper="b").select(F.lit("given"), "id", "_lower", "_upper")
    d = Sc.with_interval(V.draws(spark, sf), draws="draws").select(F.lit("draws"), "vec_id", "_lower", "_upper")
    return g.union(u).union(d).withColumnsRenamed({"_lower": "lower", "_upper": "upper"})


@query("a10_all_scores", "single", f"SELECT model, region, {EIGHT} FROM single GROUP BY model, region", rnd=EIGHT_R)
def _(spark, sf):
    return Sc.score_agg(V.preds(spark, sf), ["model", "region"], truth="truth", est="est", sd="sd")


@query("a10_all_scores_from_draws", "long_draws", """
    SELECT area, avg(est - truth) AS bias, var_pop(est - truth) AS var, avg((est - truth) * (est - truth)) AS mse, sqrt(avg((est - truth) * (est - truth))) AS rmse,
      avg(crps) AS crps, avg(hi - lo + CASE WHEN truth < lo THEN 10 * (lo - truth) ELSE 0 END + CASE WHEN truth > hi THEN 10 * (truth - hi) ELSE 0 END) AS interval_score,
      avg(CASE WHEN lo <= truth AND truth <= hi THEN 1e0 ELSE 0e0 END) AS coverage, avg(hi - lo) AS width FROM ens GROUP BY area""",
       rnd=EIGHT_R, ints="area", ctes=ENSEMBLE)
def _(spark, sf):
    return Sc.score_agg(V.draws(spark, sf), ["area"], truth="truth", draws="draws")


@query("a11_single_scores", "single", """
    SELECT id, s.model, err, sq_err, crps, interval_score, coverage, width, (err - m) * (err - m) AS var FROM single s
    JOIN (SELECT model, region, avg(err) AS m FROM single GROUP BY model, region) USING (model, region)""", rnd="err sq_err crps interval_score coverage width var")
def _(spark, sf):
    s = Sc.centred_errors(V.single(spark, sf), ["model", "region"])
    return s.select("id", "model", "err", "sq_err", "crps", "interval_score", "coverage", "width", "var")


@query("a12_ignorance", "preds", "SELECT model, avg(((truth - est) / sd) * ((truth - est) / sd) / 2 + ln(sd)) AS ign FROM preds GROUP BY model", rnd="ign")
def _(spark, sf):
    return V.preds(spark, sf).groupBy("model").agg(F.avg(Sc.ign("truth", "est", "sd")).alias("ign"))


@query("a13_pit_histogram", "preds", f"""
    SELECT model, bin, count(*) AS n, avg(p) AS mean_pit FROM (SELECT model, p, CAST(greatest(ceil(p * 10), 1) AS BIGINT) AS bin FROM
      (SELECT model, {norm_cdf_sql('((truth - est) / sd)')} AS p FROM preds)) GROUP BY model, bin""", rnd="mean_pit")
def _(spark, sf):
    p = V.preds(spark, sf).select("model", Sc.pit("truth", "est", "sd").alias("p"))
    return p.groupBy("model", F.greatest(F.ceil(F.col("p") * 10), F.lit(1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pit"))


@query("a14_observed_and_unobserved", "single", """
    SELECT model, fold <> 3 AS observed, avg(sq_err) AS mse, avg(abs_err) AS mae FROM single GROUP BY 1, 2""", rnd="mse mae")
def _(spark, sf):
    return V.single(spark, sf).groupBy("model", (F.col("fold") != 3).alias("observed")).agg(F.avg("sq_err").alias("mse"), F.avg("abs_err").alias("mae"))


@query("a15_quick_check", "preds", """
    SELECT model, avg(est - truth) AS bias, sqrt(avg((est - truth) * (est - truth))) AS rmspe,
      avg(CASE WHEN est - 10 < truth AND truth < est + 10 THEN 1e0 ELSE 0e0 END) AS coverage FROM preds GROUP BY model""", rnd="bias rmspe coverage")
def _(spark, sf):
    p = V.preds(spark, sf).withColumns({"lo": F.col("est") - 10, "hi": F.col("est") + 10})
    return Sc.quick_check(p, ["model"], "truth", "est", "lo", "hi")


@query("a16_cv_error_per_task", "single", "SELECT model, fold, count(*) AS n, avg(sq_err) AS mse FROM single GROUP BY model, fold", rnd="mse")
def _(spark, sf):
    return V.single(spark, sf).groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("sq_err").alias("mse"))


@query("a17_residual_by_covariate", "single", """
    SELECT id, north AS covariate, max(err) FILTER (WHERE model = 'A') AS a, max(err) FILTER (WHERE model = 'B') AS b, max(err) FILTER (WHERE model = 'C') AS c
    FROM single GROUP BY id, north""", rnd="covariate a b c")
def _(spark, sf):
    s = V.single(spark, sf).select("id", F.col("north").alias("covariate"), F.lower("model").alias("model"), "err")
    return pair_models(s, ["id", "covariate"], "model", "err", ["a", "b", "c"])


@query("a18_share_near", "preds", "SELECT model, region, avg(CASE WHEN dist <= 2.5::DOUBLE THEN 1e0 ELSE 0e0 END) AS share FROM preds GROUP BY model, region", rnd="share")
def _(spark, sf):
    return Sc.share_within(V.preds(spark, sf), ["model", "region"], "dist", 2.5)


EVEN = """
    breaks AS (SELECT max(dist) / 29 AS w FROM single),
    binned AS (SELECT s.*, w, greatest(1, len(list_filter(range(29), lambda i: i * w < dist))) AS bin FROM single s, breaks)"""


@query("b01_scores_by_distance", "single", f"""
    SELECT model, bin, false AS pooled, count(*) AS n_per_bin, {EIGHT}, (any_value(bin) - 1) * any_value(w) + any_value(w) / 2 AS nn_dist FROM binned GROUP BY model, bin
    UNION ALL SELECT model, NULL, true, count(*), {EIGHT}, NULL FROM binned GROUP BY model""", rnd=EIGHT_R + " nn_dist", ints="bin", ctes=EVEN)
def _(spark, sf):
    return St.scores_by_even_distance(V.single(spark, sf), "dist", 30, ["model"])


MEANS = "avg(err) AS err, avg(sq_err) AS sq_err, avg(crps) AS crps, avg(interval_score) AS interval_score, avg(coverage) AS coverage, avg(width) AS width"
MEANS_R = "err sq_err crps interval_score coverage width nn_dist"


def _equal_sql(per: str, where: str = "TRUE") -> str:
    return f"""
    cut AS (SELECT * FROM single WHERE {where}),
    ord AS (SELECT *, {per} AS per FROM (SELECT model, dist, row_number() OVER (PARTITION BY model ORDER BY dist, id) AS rn, count(*) OVER (PARTITION BY model) AS total FROM cut)),
    seams AS (SELECT model, list(edge ORDER BY k) AS edges FROM (SELECT model, k, avg(dist) AS edge FROM
      (SELECT model, dist, rn // per AS k FROM ord WHERE rn % per = 0 AND rn < total
       UNION ALL SELECT model, dist, rn // per FROM ord WHERE rn % per = 1 AND rn > 1) GROUP BY model, k) GROUP BY model),
    binned AS (SELECT c.*, list_concat([0e0], edges, [top + 1e-6]) AS br FROM cut c JOIN seams USING (model) JOIN (SELECT model, max(dist) AS top FROM cut GROUP BY model) USING (model)),
    placed AS (SELECT *, greatest(1, len(list_filter(br, lambda b: b < dist))) AS bin FROM binned)"""


EQUAL = f"SELECT model, bin, count(*) AS n_per_bin, {MEANS}, any_value(br[bin] + (br[bin + 1] - br[bin]) / 2) AS nn_dist FROM placed GROUP BY model, bin"


@query("b02_equal_count_bins", "single", EQUAL, rnd=MEANS_R, ints="bin", ctes=_equal_sql("CAST(ceil(total / 30e0) AS BIGINT)"))
def _(spark, sf):
    return St.scores_by_distance(V.single(spark, sf), "dist", "id", breaks=30, keys=["model"])


@query("b02_fixed_count_bins", "single", EQUAL, rnd=MEANS_R, ints="bin", ctes=_equal_sql("CAST(700 AS BIGINT)"))
def _(spark, sf):
    return St.scores_by_distance(V.single(spark, sf), "dist", "id", n_per_bin=700, keys=["model"])


GIVEN = [0.0, 0.5, 1.0, 2.0, 4.0, 8.0]


@query("b02_given_breaks", "single", f"""
    SELECT model, bin, count(*) AS n_per_bin, {MEANS}, any_value(br[bin] + (br[bin + 1] - br[bin]) / 2) AS nn_dist FROM
      (SELECT *, greatest(1, len(list_filter(br, lambda b: b < dist))) AS bin FROM (SELECT *, {GIVEN}::DOUBLE[] AS br FROM single WHERE dist < 8))
    GROUP BY model, bin""", rnd=MEANS_R, ints="bin")
def _(spark, sf):
    return St.scores_by_distance(V.single(spark, sf), "dist", "id", breaks=GIVEN, keys=["model"])


@query("b03_stratum_and_cutoff", "single", EQUAL, rnd=MEANS_R, ints="bin", digits=9,
       ctes=_equal_sql("CAST(ceil(total / 12e0) AS BIGINT)", "urban AND dist < 6"))
def _(spark, sf):
    s = V.single(spark, sf).where("urban")
    return St.scores_by_distance(s, "dist", "id", breaks=12, max_dist=6.0, keys=["model"])


FOLD_BINS = """
    placed AS (SELECT *, greatest(1, CAST(ceil(dist) AS BIGINT)) AS bin FROM single)"""


@query("b04_merge_binned", "single", "SELECT model, bin, count(*) AS n_per_bin, avg(sq_err) AS sq_err, avg(crps) AS crps, avg(width) AS width FROM placed GROUP BY model, bin",
       rnd="sq_err crps width", ctes=FOLD_BINS)
def _(spark, sf):
    # Tables of the single folds merged must equal the table over all rows.
    s = V.single(spark, sf)
    br = [float(i) for i in range(11)]
    tables = [St.scores_by_distance(s.where(F.col("fold").isin(f, f + 1)), "dist", "id", breaks=br, keys=["model"]) for f in (0, 2, 4, 6)]
    return St.merge_binned([None, *tables], "bin", "n_per_bin", ["sq_err", "crps", "width"], ["model"])


@query("b05_pool_bins", "single", "SELECT model, count(*) AS n_per_bin, avg(sq_err) AS sq_err, avg(crps) AS crps FROM placed GROUP BY model",
       rnd="sq_err crps", ctes=FOLD_BINS)
def _(spark, sf):
    b = St.scores_by_distance(V.single(spark, sf), "dist", "id", breaks=[float(i) for i in range(11)], keys=["model"])
    return St.pool_bins(b, "n_per_bin", ["sq_err", "crps"], ["model"])


SUBSETS = f"""
    folds AS (SELECT model, fold, 'Avg' AS subset, count(*) AS n, {EIGHT} FROM single GROUP BY model, fold
      UNION ALL SELECT model, fold, CASE WHEN urban THEN 'Urban' ELSE 'Rural' END, count(*), {EIGHT} FROM single GROUP BY model, fold, urban)"""


@query("b06_scores_by_subset", "single", "SELECT * FROM folds", rnd=EIGHT_R, ctes=SUBSETS)
def _(spark, sf):
    return St.scores_by_subset(V.single(spark, sf), ["model", "fold"])


@query("b06_flagged_subset_report", "single", """
    SELECT model, subset, n, bias, mse, crps, interval_score, coverage, width,
      abs(crps) = min(abs(crps)) OVER (PARTITION BY subset) AS crps_best, abs(crps) = max(abs(crps)) OVER (PARTITION BY subset) AS crps_worst,
      abs(coverage - 0.8::DOUBLE) = min(abs(coverage - 0.8::DOUBLE)) OVER (PARTITION BY subset) AS coverage_best,
      abs(coverage - 0.8::DOUBLE) = max(abs(coverage - 0.8::DOUBLE)) OVER (PARTITION BY subset) AS coverage_worst
    FROM pooled""", rnd="bias mse crps interval_score coverage width", ctes=f"""
    pooled AS (SELECT model, 'Avg' AS subset, count(*) AS n, {EIGHT} FROM single GROUP BY model
      UNION ALL SELECT model, CASE WHEN urban THEN 'Urban' ELSE 'Rural' END, count(*), {EIGHT} FROM single GROUP BY model, urban)""")
def _(spark, sf):
    s = St.scores_by_subset(V.single(spark, sf), ["model"])
    return flag_best_worst(s, ["crps", "coverage"], {"coverage": 0.8}, ["subset"]).drop("var", "rmse")


@query("b06_empty_strata", "single", """
    SELECT k.region, k.subset, coalesce(n, 0) AS n, crps FROM (SELECT DISTINCT region, subset FROM single, (SELECT unnest(['Avg', 'Urban', 'Rural']) AS subset)) k
    LEFT JOIN (SELECT region, 'Avg' AS subset, count(*) AS n, avg(crps) AS crps FROM kept GROUP BY region
      UNION ALL SELECT region, CASE WHEN urban THEN 'Urban' ELSE 'Rural' END, count(*), avg(crps) FROM kept GROUP BY region, urban) USING (region, subset)""",
       rnd="crps", ctes="kept AS (SELECT * FROM single WHERE urban OR region <> 'ASIA')")
def _(spark, sf):
    s = V.single(spark, sf).where("urban OR region <> 'ASIA'")
    return St.complete_subsets(St.scores_by_subset(s, ["region"]), ["region"]).select("region", "subset", "n", "crps")


@query("b07_mean_over_folds", "single", "SELECT model, subset, avg(bias) AS bias, avg(mse) AS mse, avg(crps) AS crps, avg(coverage) AS coverage FROM folds GROUP BY model, subset",
       rnd="bias mse crps coverage", ctes=SUBSETS)
def _(spark, sf):
    f = St.scores_by_subset(V.single(spark, sf), ["model", "fold"])
    return St.mean_over_folds(f, ["model", "subset"], ["bias", "mse", "crps", "coverage"]).orderBy("model", "subset")


@query("b08_left_out_columns", "single", """
    SELECT model, avg(crps) AS crps, -2 * avg(ln(sd)) AS log_scale, sum(sq_err) AS misfit FROM single GROUP BY model""", rnd="crps log_scale misfit")
def _(spark, sf):
    # A fitter's criteria arrive as columns and are only carried along; these two stand in for them.
    s = V.single(spark, sf).groupBy("model").agg(F.avg("crps").alias("crps"), (-2 * F.avg(F.ln("sd"))).alias("log_scale"), F.sum("sq_err").alias("misfit"),
                                                 F.avg("width").alias("width"))
    return s.select("model", "crps", "log_scale", "misfit")


NOISY = noise_ctes("SELECT vec_id, area, truth, 5 + vec_id % 20 AS n, list_transform(draws, lambda v: 1e0 / (1e0 + exp(-v))) AS p FROM draws", "vec_id", 1) + f""",
    noised AS (SELECT 'none' AS noise, vec_id, area, truth, i, v FROM states UNION ALL SELECT 'binomial', vec_id, area, any_value(truth), i, count(*) FILTER (u < v) / any_value(n)::DOUBLE
      FROM (SELECT *, {uniform_sql('a', 'b', 't')} AS u FROM states, range(1, 25) AS r(t) WHERE t <= n) GROUP BY vec_id, area, i)"""


@query("b09_with_and_without_noise", "draws", f"""
    SELECT area, noise, avg(truth_error) AS bias, var_pop(truth_error) AS var, avg(sq_err) AS mse, sqrt(avg(sq_err)) AS rmse, avg(crps) AS crps,
      avg(interval_score) AS interval_score, avg(coverage) AS coverage, avg(width) AS width
    FROM ({_fuzzy_sql('vec_id, area, noise', 'SELECT * FROM noised', 'min(nullif(gap, 0))')}) GROUP BY area, noise""", rnd=EIGHT_R, ints="area", ctes=NOISY)
def _(spark, sf):
    d = V.draws(spark, sf).withColumns({"draws": F.transform("draws", lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))), "n": 5 + F.col("vec_id") % 20})
    noisy = add_noise(d, "vec_id", "draws", "binomial", size="n", seed=1)
    both = d.select("vec_id", "area", "truth", F.lit("none").alias("noise"), "draws").unionByName(
        noisy.select("vec_id", "area", "truth", F.lit("binomial").alias("noise"), F.col("noisy").alias("draws")))
    return Sc.score_agg(both, ["area", "noise"], truth="truth", draws="draws", fuzzy=True)


CUT = """
    lim AS (SELECT min(dist) AS lo, max(dist) AS hi FROM preds),
    placed AS (SELECT s.*, 1 + len(list_filter(range(1, 5), lambda i: lo + i * ((hi - lo) / 5) < dist)) AS bin FROM single s, lim)"""


@query("b10_methods_by_distance", "single", """
    SELECT bin, model AS method, count(*) AS n, sqrt(avg(sq_err)) AS rmse, avg(crps) AS crps FROM placed GROUP BY bin, model""", rnd="rmse crps", ints="bin", ctes=CUT)
def _(spark, sf):
    # The wide table (one column per method) is turned long first, then one aggregate does all methods.
    s = V.single(spark, sf)
    wide = s.groupBy("id", "dist").pivot("model", ["A", "B", "C"]).agg(F.first("sq_err").alias("sq"), F.first("crps").alias("crps"))
    long = wide.select("id", "dist", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"{m}_sq").alias("sq_err"), F.col(f"{m}_crps").alias("crps")) for m in "ABC"])))
    return St.range_bins(long, "dist", 5).groupBy("bin", "method").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("sq_err")).alias("rmse"), F.avg("crps").alias("crps"))


@query("b11_equal_width_cut", "single", "SELECT bin, count(*) AS n, min(dist) AS lowest, max(dist) AS highest FROM placed GROUP BY bin", rnd="lowest highest", ints="bin", ctes=CUT)
def _(spark, sf):
    return St.range_bins(V.preds(spark, sf), "dist", 5).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("lowest"), F.max("dist").alias("highest"))


@query("b12_conditional_mean", "points", """
    SELECT bin, count(*) AS n, avg(truth) AS mean_y, (bin - 0.5::DOUBLE) * 5 AS centre FROM (SELECT truth, CAST(greatest(ceil(east / 5), 1) AS BIGINT) AS bin FROM points)
    GROUP BY bin""", rnd="mean_y centre")
def _(spark, sf):
    return St.conditional_mean(V.points(spark, sf), "east", "truth", 5.0)


@query("b13_gridded_mean", "points", """
    SELECT ix, iy, count(*) AS n, avg(truth) AS mean_z FROM (SELECT truth, CAST(least(floor((east - x0) / ((x1 - x0) / 40)), 39) AS BIGINT) + 1 AS ix,
        CAST(least(floor((north - y0) / ((y1 - y0) / 25)), 24) AS BIGINT) + 1 AS iy
      FROM points, (SELECT min(east) AS x0, max(east) AS x1, min(north) AS y0, max(north) AS y1 FROM points)) GROUP BY ix, iy""", rnd="mean_z", digits=9)
def _(spark, sf):
    return St.quilt(V.points(spark, sf), "east", "north", "truth", 40, 25)


@query("b14_scores_with_time", "single", """
    SELECT model, sqrt(avg(sq_err)) AS rmse, avg(crps) AS crps, any_value(minutes) AS minutes FROM single
    JOIN (SELECT sum(value) / 60 AS minutes, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'C' END AS model
      FROM events GROUP BY 2) USING (model) GROUP BY model""", rnd="rmse crps minutes")
def _(spark, sf):
    t = V.table(spark, sf, "events")
    t = t.groupBy(F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").otherwise("C").alias("model")).agg(
        (F.sum("value") / 60).alias("minutes"))
    s = V.single(spark, sf).groupBy("model").agg(F.sqrt(F.avg("sq_err")).alias("rmse"), F.avg("crps").alias("crps"))
    return s.join(t, "model")


@query("b15_centre_and_other_blocks", "single", f"SELECT model, id % 9 + 1 = 5 AS centre, {EIGHT} FROM single GROUP BY 1, 2", rnd=EIGHT_R)
def _(spark, sf):
    return V.single(spark, sf).groupBy("model", (F.col("id") % 9 + 1 == 5).alias("centre")).agg(*Sc.score_aggregates())


@query("b16_time_summary", "swath", """
    SELECT model, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.1::DOUBLE) AS q10, quantile_cont(value, 0.5::DOUBLE) AS q50,
      quantile_cont(value, 0.9::DOUBLE) AS q90 FROM swath GROUP BY model""", rnd="mean sd q10 q50 q90")
def _(spark, sf):
    s = V.swath(spark, sf)
    m = s.groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return m.join(group_quantiles(s, ["model"], "value", "id", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).drop("n"), "model")


@query("b17_mean_curves", "long_draws", "SELECT i AS step, avg(v) AS mean_cov, avg(v * v) AS mean_sq FROM long_draws GROUP BY i", rnd="mean_cov mean_sq", ints="step")
def _(spark, sf):
    d = V.draws(spark, sf).select(F.posexplode("draws").alias("step", "v"))
    return d.groupBy((F.col("step") + 1).alias("step")).agg(F.avg("v").alias("mean_cov"), F.avg(F.col("v") * F.col("v")).alias("mean_sq"))


@query("b18_timing_shares", sql="""
    SELECT l_orderkey, l_partkey, l_quantity / total AS l_quantity_share, l_tax / total AS l_tax_share, (total - (l_quantity + l_tax)) / total AS other_share
    FROM (SELECT *, l_extendedprice + 100 AS total FROM lineitem)""", rnd="l_quantity_share l_tax_share other_share", digits=9)
def _(spark, sf):
    t = V.table(spark, sf, "lineitem").withColumn("total", F.col("l_extendedprice") + 100)
    return St.timing_shares(t, "total", ["l_quantity", "l_tax"]).select("l_orderkey", "l_partkey", "l_quantity_share", "l_tax_share", "other_share")


NINE = """
    pairs AS (SELECT a.id, min(d) AS nn_all, min(d) FILTER (WHERE u) AS nn_urban, min(d) FILTER (WHERE NOT u) AS nn_rural FROM
      (SELECT a.id, b.urban AS u, sqrt((a.east - b.east) * (a.east - b.east) + (a.north - b.north) * (a.north - b.north)) AS d
       FROM points a, points b WHERE a.role = 'test' AND b.role = 'train') a WHERE d > 0 GROUP BY a.id),
    long AS (SELECT s.*, pred_set, obs_set, nn FROM single s JOIN
      (SELECT id, 'nn_all' AS obs_set, nn_all AS nn FROM pairs UNION ALL SELECT id, 'nn_urban', nn_urban FROM pairs UNION ALL SELECT id, 'nn_rural', nn_rural FROM pairs) USING (id),
      (SELECT 'all' AS pred_set UNION ALL SELECT 'urban' UNION ALL SELECT 'rural') WHERE pred_set = 'all' OR (pred_set = 'urban') = urban),
    wide AS (SELECT *, max(nn) OVER (PARTITION BY obs_set, pred_set) / 9 AS w FROM long),
    binned AS (SELECT *, greatest(1, len(list_filter(range(9), lambda i: i * w < nn))) AS bin FROM wide)"""


@query("b19_nine_combinations", "points single", f"""
    SELECT model, obs_set, pred_set, bin, count(*) AS n_per_bin, {EIGHT}, (bin - 1) * any_value(w) + any_value(w) / 2 AS nn_dist FROM binned GROUP BY model, obs_set, pred_set, bin""",
       rnd=EIGHT_R + " nn_dist", ints="bin", ctes=NINE)
def _(spark, sf):
    p = V.points(spark, sf)
    nn = stratified_nearest(p.where("role = 'test'"), p.where("role = 'train'"), "id", "id").drop("urban")
    s = V.single(spark, sf).join(nn, "id")
    return St.stacked_subsets(s, "nn", ["model"], ["nn_all", "nn_urban", "nn_rural"], 10)


@query("b20_adjusted_rand", "obs", """
    SELECT CAST(n AS BIGINT) AS n, (ab - a * b / (n * (n - 1) / 2e0)) / ((a + b) / 2e0 - a * b / (n * (n - 1) / 2e0)) AS adjusted_rand FROM
      (SELECT sum(c * (c - 1) / 2e0) AS ab, sum(c) AS n FROM (SELECT count(*) AS c FROM obs GROUP BY region, CASE WHEN id % 3 = 0 THEN county ELSE region END)),
      (SELECT sum(c * (c - 1) / 2e0) AS a FROM (SELECT count(*) AS c FROM obs GROUP BY region)),
      (SELECT sum(c * (c - 1) / 2e0) AS b FROM (SELECT count(*) AS c FROM obs GROUP BY CASE WHEN id % 3 = 0 THEN county ELSE region END))""", rnd="adjusted_rand")
def _(spark, sf):
    o = V.obs(spark, sf).withColumn("other", F.when(F.col("id") % 3 == 0, F.col("county")).otherwise(F.col("region")))
    return St.adjusted_rand(o, "region", "other")


@query("b21_score_spread", "single", """
    SELECT model, region, count(*) AS n, min(crps) AS q0, quantile_cont(crps, 0.25::DOUBLE) AS q25, quantile_cont(crps, 0.5::DOUBLE) AS q50,
      quantile_cont(crps, 0.75::DOUBLE) AS q75, max(crps) AS q100 FROM single GROUP BY model, region""", rnd="q0 q25 q50 q75 q100")
def _(spark, sf):
    return St.score_spread(V.single(spark, sf), ["model", "region"], "crps", "id")


@query("b22_mean_of_score_columns", "single", f"SELECT model, {MEANS}, avg(dist) AS nn_dist FROM (SELECT model, county, {MEANS}, avg(dist) AS dist FROM single GROUP BY model, county) GROUP BY model",
       rnd=MEANS_R)
def _(spark, sf):
    area = V.single(spark, sf).groupBy("model", "county").agg(*[F.avg(s).alias(s) for s in St.SINGLE], F.avg("dist").alias("nn_dist"))
    return area.groupBy("model").agg(*[F.avg(s).alias(s) for s in (*St.SINGLE, "nn_dist")])


@query("b23_stacked_parameters", "preds", """
    SELECT 'A' AS model, county, avg(est) AS est, avg(sd) AS sd FROM preds WHERE model = 'A' GROUP BY county
    UNION ALL SELECT model, county, avg(est), NULL FROM preds WHERE model <> 'A' GROUP BY model, county""", rnd="est sd")
def _(spark, sf):
    p = V.preds(spark, sf)
    a = p.where("model = 'A'").groupBy("model", "county").agg(F.avg("est").alias("est"), F.avg("sd").alias("sd"))
    b = p.where("model <> 'A'").groupBy("model", "county").agg(F.avg("est").alias("est"))
    return a.unionByName(b, allowMissingColumns=True)
