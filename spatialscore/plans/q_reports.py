"""Queries for ranking, flags and ordered windows (W, G2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as Cm
from ..operators import scoring as Sc
from ..operators import strata as St
from ..operators.ordering import next_value, ordered
from . import views as V
from .q_aggregates import EIGHT
from .q_areas import CURVES, curves, long_draws
from .registry import query

METRICS = ["mae", "rmse", "crps", "interval_score", "coverage"]
TABLE = """
    methods AS (SELECT model || fold AS method, avg(abs_err) AS mae, sqrt(avg(sq_err)) AS rmse, avg(crps) AS crps, avg(interval_score) AS interval_score,
      avg(coverage) AS coverage FROM single GROUP BY model, fold),
    ranks AS (SELECT method, row_number() OVER (ORDER BY round(mae, 9), method) AS rank_mae, row_number() OVER (ORDER BY round(rmse, 9), method) AS rank_rmse,
      row_number() OVER (ORDER BY round(crps, 9), method) AS rank_crps, row_number() OVER (ORDER BY round(interval_score, 9), method) AS rank_interval_score,
      row_number() OVER (ORDER BY round(abs(coverage - 0.95::DOUBLE), 9), method) AS rank_coverage FROM methods),
    means AS (SELECT *, (rank_mae + rank_rmse + rank_crps + rank_interval_score + rank_coverage) / 5e0 AS mean_rank FROM ranks)"""


def method_table(spark, sf):
    s = V.single(spark, sf)
    return s.groupBy(F.concat("model", F.col("fold").cast("string")).alias("method")).agg(
        F.avg("abs_err").alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse"), F.avg("crps").alias("crps"),
        F.avg("interval_score").alias("interval_score"), F.avg("coverage").alias("coverage"))


@query("w01_rank_methods", "single", "SELECT * FROM means", rnd="mean_rank", ctes=TABLE)
def _(spark, sf):
    return Cm.rank_methods(method_table(spark, sf), "method", METRICS, {"coverage": 0.95})


@query("w02_rank_report", "single", "SELECT method, mean_rank FROM means ORDER BY substr(method, 1, 2), mean_rank, method", rnd="mean_rank", ctes=TABLE)
def _(spark, sf):
    r = Cm.rank_methods(method_table(spark, sf), "method", METRICS, {"coverage": 0.95})
    return Cm.rank_report(r, "method").select("method", "mean_rank")


@query("w03_best_and_worst", "single", """
    SELECT method, abs(crps) = min(abs(crps)) OVER () AS crps_best, abs(crps) = max(abs(crps)) OVER () AS crps_worst,
      abs(100 * coverage - 80) = min(abs(100 * coverage - 80)) OVER () AS cov_best, abs(100 * coverage - 80) = max(abs(100 * coverage - 80)) OVER () AS cov_worst FROM methods""",
       ctes=TABLE)
def _(spark, sf):
    m = method_table(spark, sf).select("method", "crps", (F.col("coverage") * 100).alias("cov"))
    return Cm.flag_best_worst(m, ["crps", "cov"], {"cov": 80.0}).drop("crps", "cov")


@query("w04_running_population", "pixels", """
    SELECT county, pixel, sum(pop) OVER (PARTITION BY county ORDER BY pop, pixel ROWS UNBOUNDED PRECEDING) AS cum FROM pixels""", ints="cum")
def _(spark, sf):
    return ordered(V.pixels(spark, sf).select("county", "pixel", "pop"), ["county"], "pop", "pixel", sums={"cum": "pop"}).select("county", "pixel", "cum")


@query("w05_row_numbers", "single", """
    SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY dist, id) AS rn, rank() OVER (PARTITION BY model ORDER BY dist) AS rank FROM single""")
def _(spark, sf):
    return ordered(V.preds(spark, sf).select("model", "id", "dist"), ["model"], "dist", "id").select("model", "id", "rn", "rank")


@query("w06_first_in_order", sql="SELECT p_partkey, min(d) AS first_d FROM curves WHERE cor <= 0.5::DOUBLE GROUP BY p_partkey", ctes=CURVES, ints="first_d")
def _(spark, sf):
    return curves(spark, sf).groupBy("p_partkey").agg(F.min(F.when(F.col("cor") <= 0.5, F.col("d"))).alias("first_d")).where("first_d IS NOT NULL")


@query("w07_cumulative_weights", "long_draws", """
    SELECT area, vec_id, i, sum(w) OVER (PARTITION BY area ORDER BY v, vec_id * 100 + i ROWS UNBOUNDED PRECEDING) AS cum FROM long_draws""", rnd="cum", ints="area i")
def _(spark, sf):
    d = long_draws(spark, sf).withColumn("atom", F.col("vec_id") * 100 + F.col("i")).select("area", "vec_id", "i", "v", "w", "atom")
    return ordered(d, ["area"], "v", "atom", sums={"cum": "w"}).select("area", "vec_id", "i", "cum")


@query("w08_centred_errors", "single", "SELECT id, model, (err - avg(err) OVER (PARTITION BY model)) * (err - avg(err) OVER (PARTITION BY model)) AS var FROM single", rnd="var")
def _(spark, sf):
    return Sc.centred_errors(V.single(spark, sf), ["model"]).select("id", "model", "var")


@query("w09_axis_spacing", "points", "SELECT value, lead(value) OVER (ORDER BY value) - value AS step FROM (SELECT DISTINCT east AS value FROM points)", rnd="value step")
def _(spark, sf):
    n = next_value(V.points(spark, sf).select(F.col("east").alias("value")), "value")
    return n.select("value", (F.col("next") - F.col("value")).alias("step"))


@query("g02_pooled_and_strata", "single", f"""
    SELECT model, 'Avg' AS subset, count(*) AS n, {EIGHT} FROM single GROUP BY model
    UNION ALL SELECT model, CASE WHEN urban THEN 'Urban' ELSE 'Rural' END, count(*), {EIGHT} FROM single GROUP BY model, urban""",
       rnd="bias var mse rmse crps interval_score coverage width")
def _(spark, sf):
    return St.scores_by_subset(V.single(spark, sf), ["model"])
