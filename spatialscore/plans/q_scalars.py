"""Queries for scalar transforms, projections and knots (P, X)."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import draws as Dr
from ..functions import projections as Pj
from ..functions import transforms as Tf
from ..functions.normal import INV_SQRT_2PI, norm_cdf, norm_cdf_sql, norm_pdf, norm_ppf_const
from ..operators.areal import domain_box
from ..operators.compare import percent_diff
from . import views as V
from .registry import query


@query("p01_logit", sql="SELECT l_orderkey, l_partkey, ln((l_tax + 0.01::DOUBLE) / (1 - (l_tax + 0.01::DOUBLE))) AS z FROM lineitem", rnd="z")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").withColumn("p", F.col("l_tax") + 0.01).select("l_orderkey", "l_partkey", Tf.logit("p").alias("z"))


@query("p02_expit", sql="""
    SELECT c_custkey, CASE WHEN x > 100 THEN 1e0 WHEN x < -100 THEN 0e0 ELSE exp(x) / (1 + exp(x)) END AS p
    FROM (SELECT c_custkey, c_acctbal / 20 - 100 AS x FROM customer)""", rnd="p", digits=8)
def _(spark, sf):
    return V.table(spark, sf, "customer").withColumn("x", F.col("c_acctbal") / 20 - 100).select("c_custkey", Tf.expit("x").alias("p"))


@query("p03_shrunk_logit", sql="""
    SELECT l_orderkey, l_partkey, z, (exp(z) / (1 + exp(z)) - 0.5::DOUBLE) / 0.84::DOUBLE + 0.5::DOUBLE AS back FROM (
      SELECT l_orderkey, l_partkey, ln(((q - 0.5::DOUBLE) * 0.84::DOUBLE + 0.5::DOUBLE) / (1 - ((q - 0.5::DOUBLE) * 0.84::DOUBLE + 0.5::DOUBLE))) AS z
      FROM (SELECT l_orderkey, l_partkey, (l_quantity - 1) / 49 AS q FROM lineitem))""", rnd="z back")
def _(spark, sf):
    q = V.table(spark, sf, "lineitem").withColumn("q", (F.col("l_quantity") - 1) / 49).withColumn("z", Tf.shrunk_logit("q"))
    return q.select("l_orderkey", "l_partkey", "z", Tf.shrunk_expit("z").alias("back"))


SIMPLEX = """SELECT *, x1 + x2 AS s FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_discount + 0.01::DOUBLE) / 0.5::DOUBLE AS x1,
      (l_tax + 0.01::DOUBLE) / 0.5::DOUBLE AS x2 FROM lineitem)"""


@query("p04_multivariate_logit", sql=f"""
    SELECT l_orderkey, l_partkey, z1, z2, exp(z1) / (1 + exp(z1) + exp(z2)) AS b1, exp(z2) / (1 + exp(z1) + exp(z2)) AS b2
    FROM (SELECT l_orderkey, l_partkey, ln(x1 / (1 - s)) AS z1, ln(x2 / (1 - s)) AS z2 FROM ({SIMPLEX}))""", rnd="z1 z2 b1 b2")
def _(spark, sf):
    x = V.table(spark, sf, "lineitem").withColumn("x", F.array((F.col("l_discount") + 0.01) / 0.5, (F.col("l_tax") + 0.01) / 0.5))
    z = x.withColumn("z", Tf.multi_logit("x")).withColumn("b", Tf.multi_expit("z"))
    return z.select("l_orderkey", "l_partkey", F.col("z")[0].alias("z1"), F.col("z")[1].alias("z2"), F.col("b")[0].alias("b1"), F.col("b")[1].alias("b2"))


@query("p05_layer_weights", sql="""
    SELECT p_partkey, w1 / (w1 + w2 + w3) AS a1, w2 / (w1 + w2 + w3) AS a2, w3 / (w1 + w2 + w3) AS a3 FROM (
      SELECT p_partkey, pow(2e0, -2e0 * nu) AS w1, pow(2e0, -4e0 * nu) AS w2, pow(2e0, -6e0 * nu) AS w3
      FROM (SELECT p_partkey, p_size / 20e0 AS nu FROM part))""", rnd="a1 a2 a3")
def _(spark, sf):
    a = V.table(spark, sf, "part").select("p_partkey", Tf.layer_weights(3, F.col("p_size") / 20.0).alias("a"))
    return a.select("p_partkey", *[F.col("a")[i].alias(f"a{i + 1}") for i in range(3)])


@query("p06_clamp", "preds long_draws", """
    SELECT id AS key, CASE WHEN est < 0 THEN 0 WHEN est > 40 THEN 40 ELSE est END AS v FROM preds
    UNION ALL SELECT vec_id, sum(greatest(least(v, 1e0), 0e0)) FROM long_draws GROUP BY vec_id""", rnd="v")
def _(spark, sf):
    a = V.preds(spark, sf).select(F.col("id").alias("key"), Tf.clamp("est", 0, 40).alias("v"))
    b = V.draws(spark, sf).select("vec_id", Tf.array_sum(Tf.clamp_array("draws", 0, 1)))
    return a.union(b)


@query("p07_lognormal_moments", "preds", """
    SELECT id, model, exp(m + v / 2) AS mean, (exp(v) - 1) * exp(m + v / 2) * exp(m + v / 2) AS var
    FROM (SELECT id, model, est / 200 AS m, sd / 100 AS v FROM preds)""", rnd="mean var")
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", Tf.lognormal_moments(F.col("est") / 200, F.col("sd") / 100).alias("m")).select("id", "model", "m.*")


@query("p08_log_response", sql="SELECT p_partkey, ln(p_retailprice / 10) AS v FROM part", rnd="v")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", Tf.log_scaled("p_retailprice", 10).alias("v"))


ANGLE = math.pi / 6
C, S = f"{math.cos(ANGLE)!r}::DOUBLE", f"{math.sin(ANGLE)!r}::DOUBLE"


@query("p09_centre_and_rotate", "points", f"""
    SELECT id, u, v, {C} * u + {S} * v + cx AS east, {C} * v - {S} * u + cy AS north FROM (
      SELECT id, cx, cy, {C} * (east - cx) - {S} * (north - cy) AS u, {S} * (east - cx) + {C} * (north - cy) AS v
      FROM points, (SELECT avg(east) AS cx, avg(north) AS cy FROM points))""", rnd="u v east north")
def _(spark, sf):
    p = V.points(spark, sf)
    box = domain_box(p, "east", "north")
    p = p.withColumns({"cx": box.select("x_mean").scalar(), "cy": box.select("y_mean").scalar()})
    u, v = Pj.rotate("east", "north", ANGLE, "cx", "cy")
    r = p.select("id", "cx", "cy", u.alias("u"), v.alias("v"))
    e, n = Pj.rotate("u", "v", ANGLE, "cx", "cy", inverse=True)
    return r.select("id", "u", "v", e.alias("east"), n.alias("north"))


def inside(swath, domain):
    """All rows; places outside a projection's domain become NULL."""
    return swath.withColumns({c: F.when(domain, F.col(c)) for c in ("lon", "lat")})


@query("p10_mercator", "swath", """
    SELECT id, x, y, degrees(x / 6378.137::DOUBLE) AS lon, degrees(2e0 * atan(exp(y / 6378.137::DOUBLE)) - pi() / 2) AS lat FROM (
      SELECT id, 6378.137::DOUBLE * radians(lon) AS x, 6378.137::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM (
        SELECT id, CASE WHEN abs(lat) < 85 THEN lon END AS lon, CASE WHEN abs(lat) < 85 THEN lat END AS lat FROM swath))""",
       rnd="x y lon lat")
def _(spark, sf):
    s = inside(V.swath(spark, sf), F.abs("lat") < 85)
    x, y = Pj.mercator("lon", "lat")
    m = s.select("id", x.alias("x"), y.alias("y"))
    lon, lat = Pj.mercator("x", "y", inverse=True)
    return m.select("id", "x", "y", lon.alias("lon"), lat.alias("lat"))


E_, N_, F_, R0_ = Pj.lcc_constants()


@query("p11_lambert_conic", "swath", f"""
    SELECT id, rho * sin(th) AS x, {R0_!r}::DOUBLE - rho * cos(th) AS y FROM (
      SELECT id, {Pj.GRS80_A_KM * F_!r}::DOUBLE * pow(tan(pi() / 4 - phi / 2) / pow((1 - es) / (1 + es), {E_ / 2!r}::DOUBLE), {N_!r}::DOUBLE) AS rho,
        {N_!r}::DOUBLE * radians(lon + 96) AS th
      FROM (SELECT id, lon, radians(lat) AS phi, {E_!r}::DOUBLE * sin(radians(lat)) AS es FROM (
        SELECT id, CASE WHEN lat > 0 AND lat < 80 THEN lon END AS lon, CASE WHEN lat > 0 AND lat < 80 THEN lat END AS lat FROM swath)))""", rnd="x y")
def _(spark, sf):
    x, y = Pj.lcc("lon", "lat")
    return inside(V.swath(spark, sf), (F.col("lat") > 0) & (F.col("lat") < 80)).select("id", x.alias("x"), y.alias("y"))


def _tmerc_sql() -> tuple[str, str]:
    c, rect, alpha, _, _ = Pj.tmerc_constants()
    fwd = f"""SELECT id, lon, lat, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (
        SELECT id, lon, lat, radians(lon - 39) AS lam, sinh(atanh(sin(radians(lat))) - {c!r}::DOUBLE * atanh({c!r}::DOUBLE * sin(radians(lat)))) AS t
        FROM (SELECT id, 34 + east / 12 AS lon, -5 + north / 10 AS lat FROM points))"""
    e, n = "eta", "xi"
    for j, a in enumerate(alpha, start=1):
        e += f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        n += f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = f"{0.9996 * rect!r}::DOUBLE"
    return fwd, f"SELECT id, 500 + {k} * ({e}) AS e, 10000 + {k} * ({n}) AS n, lon, lat FROM ({fwd})"


@query("p12_transverse_mercator", "points", _tmerc_sql()[1], rnd="e n lon lat")
def _(spark, sf):
    # The inverse must return the degrees it came from, so the checking SQL lists those.
    p = V.points(spark, sf).select("id", (F.col("east") / 12 + 34).alias("lon"), (F.col("north") / 10 - 5).alias("lat"))
    e, n = Pj.tmerc("lon", "lat")
    q = p.select("id", e.alias("e"), n.alias("n"))
    lon, lat = Pj.tmerc("e", "n", inverse=True)
    return q.select("id", "e", "n", lon.alias("lon"), lat.alias("lat"))


@query("p13_min_max_scale", "points", """
    SELECT id, (east - x0) / (x1 - x0) AS u, (north - y0) / (y1 - y0) AS v FROM points,
      (SELECT min(east) AS x0, max(east) AS x1, min(north) AS y0, max(north) AS y1 FROM points)""", rnd="u v")
def _(spark, sf):
    p = V.points(spark, sf)
    box = domain_box(p, "east", "north")
    p = p.withColumns({c: box.select(c).scalar() for c in ("x_min", "x_max", "y_min", "y_max")})
    return p.select("id", ((F.col("east") - F.col("x_min")) / (F.col("x_max") - F.col("x_min"))).alias("u"),
                    ((F.col("north") - F.col("y_min")) / (F.col("y_max") - F.col("y_min"))).alias("v"))


@query("p14_centre_at_midrange", "points", """
    SELECT id, east - mx AS u, north - my AS v FROM points,
      (SELECT (min(east) + max(east)) / 2 AS mx, (min(north) + max(north)) / 2 AS my FROM points)""", rnd="u v")
def _(spark, sf):
    p = V.points(spark, sf)
    mid = p.agg(((F.min("east") + F.max("east")) / 2).alias("mx"), ((F.min("north") + F.max("north")) / 2).alias("my"))
    return p.select("id", (F.col("east") - mid.select("mx").scalar()).alias("u"), (F.col("north") - mid.select("my").scalar()).alias("v"))


@query("p15_polynomial_covariates", "points", """
    SELECT id, s, s * s AS s2 FROM (SELECT id, (east - m) / sd AS s FROM points, (SELECT avg(east) AS m, stddev_samp(east) AS sd FROM points))""", rnd="s s2")
def _(spark, sf):
    p = V.points(spark, sf)
    st = p.agg(F.avg("east").alias("m"), F.stddev_samp("east").alias("sd"))
    p = p.withColumns({"m": st.select("m").scalar(), "sd": st.select("sd").scalar()})
    s, s2 = Tf.polynomial("east", F.col("m"), F.col("sd"))
    return p.select("id", s.alias("s"), s2.alias("s2"))


Z975 = f"{norm_ppf_const(0.975)!r}::DOUBLE"


@query("p16_sd_from_interval", "preds", f"SELECT id, model, ((est + sd) - (est - 2 * sd)) / (2 * {Z975}) AS s FROM preds", rnd="s")
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", Tf.sd_from_interval(F.col("est") - 2 * F.col("sd"), F.col("est") + F.col("sd")).alias("s"))


@query("p17_interval_from_sd", "preds", f"SELECT id, model, est - {Z975} * sd AS lower, est + {Z975} * sd AS upper FROM preds", rnd="lower upper")
def _(spark, sf):
    lo, hi = Tf.interval_from_sd("est", "sd", 0.95)
    return V.preds(spark, sf).select("id", "model", lo.alias("lower"), hi.alias("upper"))


@query("p18_nugget_sd", "preds", """
    SELECT id, model, (sqrt(sd * sd + 1) + sqrt(sd * sd + 2.5::DOUBLE) + sqrt(sd * sd + 4)) / 3 AS s FROM preds""", rnd="s")
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", Tf.add_nugget_sd("sd", [1.0, 2.5, 4.0]).alias("s"))


@query("p19_normal_pdf_cdf", "preds", f"""
    SELECT id, model, {INV_SQRT_2PI!r}::DOUBLE * exp(-0.5::DOUBLE * z * z) AS pdf, {norm_cdf_sql('z')} AS cdf
    FROM (SELECT id, model, (truth - est) / sd AS z FROM preds)""", rnd="pdf cdf", digits=9)
def _(spark, sf):
    z = V.preds(spark, sf).select("id", "model", ((F.col("truth") - F.col("est")) / F.col("sd")).alias("z"))
    return z.select("id", "model", norm_pdf("z").alias("pdf"), norm_cdf("z").alias("cdf"))


@query("p20_proportion", "obs", "SELECT id, (id % 7) / nullif(CAST(n - 1 AS DOUBLE), 0) AS p FROM obs", rnd="p")
def _(spark, sf):
    return V.obs(spark, sf).select("id", Tf.proportion(F.col("id") % 7, F.col("n") - 1).alias("p"))


@query("p21_stratum_key", "obs", "SELECT id, county || CASE WHEN urban THEN 'U' ELSE 'R' END AS stratum FROM obs")
def _(spark, sf):
    return V.obs(spark, sf).select("id", Tf.stratum_key("county", "urban").alias("stratum"))


@query("p22_name_repair", "obs", """
    SELECT id, CASE region WHEN 'AFRICA' THEN 'Africa' WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE region END AS region FROM obs""")
def _(spark, sf):
    return V.obs(spark, sf).select("id", Tf.repair_names("region", {"AFRICA": "Africa", "MIDDLE EAST": "Middle East"}).alias("region"))


@query("p23_rename_models", sql="""
    SELECT p_partkey, regexp_replace(regexp_replace(p_brand, 'Brand#', 'M', 'g'), '([0-9])$', '_\\1', 'g') AS label FROM part""")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", Tf.substitute("p_brand", [("Brand#", "M"), ("([0-9])$", "_$1")]).alias("label"))


@query("p24_percent_difference", "preds", """
    SELECT a.county, a.model, a.est, 100 * (a.est - b.est) / b.est AS pct_diff
    FROM (SELECT county, model, avg(est) AS est FROM preds GROUP BY county, model) a
    JOIN (SELECT county, avg(est) AS est FROM preds WHERE model = 'A' GROUP BY county) b USING (county)""", rnd="est pct_diff")
def _(spark, sf):
    m = V.preds(spark, sf).groupBy("county", "model").agg(F.avg("est").alias("est"))
    return percent_diff(m, ["county"], "model", "est", "A")


@query("p25_interval_width", "long_draws", """
    SELECT vec_id, quantile_cont(v, 0.9::DOUBLE) - quantile_cont(v, 0.1::DOUBLE) AS width FROM long_draws GROUP BY vec_id""", rnd="width")
def _(spark, sf):
    d = Dr.with_draw_stats(V.draws(spark, sf), "draws")
    return d.select("vec_id", (Dr.quantile_sorted("_sorted", 0.9) - Dr.quantile_sorted("_sorted", 0.1)).alias("width"))


@query("p26_report_units", "single", """
    SELECT model, round(100 * avg(coverage), 1) AS coverage_pct, round(sum(width) / 60, 2) AS minutes, round(sum(width) / 3600, 3) AS hours
    FROM single GROUP BY model""", rnd="coverage_pct minutes hours")
def _(spark, sf):
    return V.single(spark, sf).groupBy("model").agg(
        F.round(F.avg("coverage") * 100, 1).alias("coverage_pct"), F.round(F.sum("width") / 60, 2).alias("minutes"),
        F.round(F.sum("width") / 3600, 3).alias("hours"))


KNOTS = [0.0, 5.0, 12.5, 30.0, 31.0, 70.0, 100.0]


@query("p27_snap_to_knots", "points", f"""
    SELECT id, (SELECT k FROM (SELECT unnest({KNOTS}::DOUBLE[]) AS k) ORDER BY abs(north - k), k DESC LIMIT 1) AS knot FROM points""", rnd="knot")
def _(spark, sf):
    return V.points(spark, sf).select("id", B.snap_to_knots("north", KNOTS).alias("knot"))


@query("p28_knot_cell", "points", """
    SELECT id, xi AS x_index, yi AS y_index, (xi - 1) * 30 + yi AS cell, x0 + (xi - 1) * wx AS x_low, x0 + xi * wx AS x_high,
      y0 + (yi - 1) * wy AS y_low, y0 + yi * wy AS y_high
    FROM (SELECT *, CAST(floor((east - x0) / wx) AS BIGINT) + 1 AS xi, CAST(floor((north - y0) / wy) AS BIGINT) + 1 AS yi
      FROM (SELECT *, (x1 + 1e-6 - x0) / 30 AS wx, (y1 + 1e-6 - y0) / 30 AS wy FROM points,
        (SELECT min(east) AS x0, max(east) AS x1, min(north) AS y0, max(north) AS y1 FROM points)))""", rnd="x_low x_high y_low y_high")
def _(spark, sf):
    p = V.points(spark, sf)
    box = domain_box(p, "east", "north")
    p = p.withColumns({c: box.select(c).scalar() for c in ("x_min", "x_max", "y_min", "y_max")})
    cell = B.knot_cell("east", "north", ("x_min", "x_max"), ("y_min", "y_max"))
    return p.select("id", *[c.alias(n) for n, c in cell.items()])


R8 = f"{math.sqrt(8.0)!r}::DOUBLE"


@query("p29_range_and_kappa", sql=f"""
    SELECT p_partkey, {R8} / r * w AS kappa, {R8} / ({R8} / r * w) * w AS r FROM
      (SELECT p_partkey, p_retailprice / 100 AS r, CAST(p_size AS DOUBLE) AS w FROM part)""", rnd="kappa r")
def _(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("r"), F.col("p_size").cast("double").alias("w"))
    p = p.withColumn("kappa", Tf.kappa_from_range("r", "w"))
    return p.select("p_partkey", "kappa", Tf.range_from_kappa("kappa", "w").alias("r"))


@query("p30_correlation", "preds", f"""
    SELECT id, model, exp(-d / 3) AS expo, (1 + {math.sqrt(3.0)!r}::DOUBLE * (d / 4)) * exp(-({math.sqrt(3.0)!r}::DOUBLE * (d / 4))) AS m32,
      (1 + {math.sqrt(5.0)!r}::DOUBLE * (d / 2) + 5 * (d / 2) * (d / 2) / 3) * exp(-({math.sqrt(5.0)!r}::DOUBLE * (d / 2))) AS m52,
      0.3::DOUBLE * exp(-d / 1) + 0.7::DOUBLE * exp(-d / 8) AS mix FROM (SELECT id, model, dist AS d FROM preds)""", rnd="expo m32 m52 mix")
def _(spark, sf):
    return V.preds(spark, sf).select(
        "id", "model", Tf.correlation("dist", "exponential", F.lit(3.0)).alias("expo"),
        Tf.correlation("dist", "matern", F.lit(4.0), 1.5).alias("m32"), Tf.correlation("dist", "matern", F.lit(2.0), 2.5).alias("m52"),
        Tf.correlation("dist", "mixture", [F.lit(1.0), F.lit(8.0)], 0.5, [0.3, 0.7]).alias("mix"))


@query("p31_standardised_residual", "preds", "SELECT id, model, (est - truth) / sd AS z FROM preds", rnd="z", digits=9)
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", Tf.standardised_residual("est", "truth", "sd").alias("z"))


@query("p32_bisquare", "preds", """
    SELECT id, model, CASE WHEN dist <= 6 THEN (1 - (dist / 6) * (dist / 6)) * (1 - (dist / 6) * (dist / 6)) ELSE 0 END AS w FROM preds""", rnd="w")
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", Tf.bisquare("dist", F.lit(6.0)).alias("w"))


@query("x03_scaled_bins", "points", """
    SELECT b AS bin, count(*) AS n, exp(min(ln(truth))) AS lowest FROM (SELECT *, CAST(floor(ln(truth) * 2) AS BIGINT) AS b FROM points) GROUP BY b""", rnd="lowest")
def _(spark, sf):
    # Any Column -> Column pair serves as scale and inverse.
    scale, inverse = F.ln, F.exp
    p = V.points(spark, sf).withColumn("s", scale(F.col("truth")))
    return p.groupBy(F.floor(F.col("s") * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"), inverse(F.min("s")).alias("lowest"))


@query("x04_any_draw_reducer", "long_draws", "SELECT vec_id, max(v) - min(v) AS spread FROM long_draws GROUP BY vec_id", rnd="spread")
def _(spark, sf):
    return V.draws(spark, sf).select("vec_id", Dr.reduce_draws("draws", lambda d: F.array_max(d) - F.array_min(d)).alias("spread"))


@query("x05_five_numbers", "long_draws", """
    SELECT vec_id, avg(v) AS est, stddev_samp(v) AS sd, quantile_cont(v, 0.1::DOUBLE) AS q_lower, quantile_cont(v, 0.5::DOUBLE) AS q50,
      quantile_cont(v, 0.9::DOUBLE) AS q_upper FROM long_draws GROUP BY vec_id""", rnd="est sd q_lower q50 q_upper")
def _(spark, sf):
    d = Dr.with_draw_stats(V.draws(spark, sf), "draws")
    return d.select("vec_id", Dr.five_numbers("draws", F.col("_sorted")).alias("f")).select("vec_id", "f.*")


@query("x06_one_to_many", "points", """
    SELECT id, CAST(floor(east) AS BIGINT) + dx AS cx, CAST(floor(north) AS BIGINT) + dy AS cy FROM points,
      (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)""")
def _(spark, sf):
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    p = V.points(spark, sf).select("id", "east", "north", step.alias("dx")).select("*", step.alias("dy"))
    return p.select("id", (F.floor("east") + F.col("dx")).alias("cx"), (F.floor("north") + F.col("dy")).alias("cy"))
