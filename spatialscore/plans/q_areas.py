"""Queries for draws, areas, populations and lattices (D)."""
from __future__ import annotations



from pyspark.sql import functions as F

from ..operators import areal as Ar
from ..operators import posterior as Po
from ..operators import scoring as Sc
from ..operators import spatial as Sp
from ..operators.lattice import lattice_sizes, smallest_lattice
from ..operators.ordering import group_quantiles, portable_hash_sql
from ..session import written
from . import views as V
from .q_joins import CENTROIDS, LAGS, THRESH
from .q_scans import AREA_HITS
from .registry import query

SUMMARY = """avg(v) AS est, stddev_samp(v) AS sd, quantile_cont(v, 0.1::DOUBLE) AS q10, quantile_cont(v, 0.5::DOUBLE) AS q50,
    quantile_cont(v, 0.9::DOUBLE) AS q90"""
SUMMARY_R = "est sd q10 q50 q90"


@query("d01_location_summary", "long_draws", f"SELECT vec_id, {SUMMARY} FROM long_draws GROUP BY vec_id", rnd=SUMMARY_R)
def _(spark, sf):
    return Po.summarise_draws(V.draws(spark, sf), "draws").select("vec_id", "est", "sd", "q10", "q50", "q90")


def long_draws(spark, sf):
    d = V.draws(spark, sf)
    return d.select("vec_id", "area", "truth", "w", F.posexplode("draws").alias("i", "v")).withColumn("i", F.col("i") + 1)


@query("d02_parameter_summary", "long_draws", """
    SELECT i AS param, avg(v) AS est, stddev_samp(v) AS sd, quantile_cont(v, 0.1::DOUBLE) AS q_lower, quantile_cont(v, 0.5::DOUBLE) AS q50,
      quantile_cont(v, 0.9::DOUBLE) AS q_upper FROM long_draws GROUP BY i""", rnd="est sd q_lower q50 q_upper", ints="param")
def _(spark, sf):
    return Po.summarise_parameters(long_draws(spark, sf).withColumnRenamed("i", "param"), ["param"], "v", "vec_id", 0.8)


@query("d03_derived_parameters", "draws", """
    SELECT vec_id, s + c AS total_var, sqrt(s + c) AS total_sd, sqrt(s) AS spatial_sd, sqrt(c) AS cluster_sd, 1 - (a1 + a2) AS alpha3 FROM
      (SELECT vec_id, abs(draws[1]) AS s, abs(draws[2]) AS c, abs(draws[3]) / 20 AS a1, abs(draws[4]) / 20 AS a2 FROM draws)""",
       rnd="total_var total_sd spatial_sd cluster_sd alpha3")
def _(spark, sf):
    d = V.draws(spark, sf).select("vec_id", F.abs(F.col("draws")[0]).alias("spatial_var"), F.abs(F.col("draws")[1]).alias("cluster_var"),
                                  (F.abs(F.col("draws")[2]) / 20).alias("alpha1"), (F.abs(F.col("draws")[3]) / 20).alias("alpha2"))
    return Po.derive_params(d, 3).select("vec_id", "total_var", "total_sd", "spatial_sd", "cluster_sd", "alpha3")


@query("d04_areal_draws", "long_draws", f"""
    SELECT area, {SUMMARY} FROM (SELECT area, i, sum(w * v) / sum(w) AS v FROM long_draws GROUP BY area, i) GROUP BY area""", rnd=SUMMARY_R, ints="area")
def _(spark, sf):
    a = Po.areal_draws(V.draws(spark, sf), ["area"], "w", "draws")
    return Po.summarise_draws(a, "draws").select("area", "est", "sd", "q10", "q50", "q90")


@query("d05_all_levels", "long_draws", f"""
    SELECT 'pixel' AS level, CAST(vec_id AS VARCHAR) AS area, {SUMMARY} FROM long_draws GROUP BY vec_id
    UNION ALL SELECT 'county', CAST(area AS VARCHAR), {SUMMARY} FROM (SELECT area, i, sum(w * v) / sum(w) AS v FROM long_draws GROUP BY area, i) GROUP BY area
    UNION ALL SELECT 'region', CAST(region AS VARCHAR), {SUMMARY} FROM (SELECT area % 3 AS region, i, sum(w * v) / sum(w) AS v FROM long_draws GROUP BY 1, 2) GROUP BY region""",
       rnd=SUMMARY_R)
def _(spark, sf):
    d = V.draws(spark, sf).withColumn("region", F.col("area") % 3)
    return Po.aggregate_levels(d, {"county": ["area"], "region": ["region"]}, "w", "draws", pixel_key="vec_id")


@query("d06_fraction_urban", "pixels", "SELECT county, sum(CASE WHEN urban THEN pop ELSE 0 END) / CAST(sum(pop) AS DOUBLE) AS frac_urban FROM pixels GROUP BY county", rnd="frac_urban")
def _(spark, sf):
    p = V.pixels(spark, sf).withColumns({"pop": F.col("pop").cast("double"), "pop_urb": F.when(F.col("urban"), F.col("pop")).otherwise(0).cast("double")})
    return Ar.fraction_urban(p, "county", "pop_urb", "pop")


@query("d07_block_mean", "points", """
    SELECT CAST((CASE WHEN north <= 30 THEN 1 WHEN north <= 60 THEN 2 WHEN north <= 90 THEN 3 END - 1) * 3
      + CASE WHEN east <= 30 THEN 1 WHEN east <= 60 THEN 2 WHEN east <= 90 THEN 3 END AS BIGINT) AS block, count(*) AS n, avg(truth) AS value
    FROM points GROUP BY 1""", rnd="value", digits=9)
def _(spark, sf):
    return Ar.block_aggregate(V.points(spark, sf), "east", "north", "truth", (0, 90), (0, 90))


@query("d08_block_draw_scores", "long_draws", """
    SELECT part, avg(est - truth) AS bias, avg((est - truth) * (est - truth)) AS mse, avg(CASE WHEN lo <= truth AND truth <= hi THEN 1e0 ELSE 0e0 END) AS coverage,
      avg(hi - lo) AS width FROM (SELECT est, lo, hi, truth, unnest(['all', CASE WHEN block = 5 THEN 'centre' ELSE 'others' END]) AS part FROM
        (SELECT area, block, avg(v) AS est, quantile_cont(v, 0.1::DOUBLE) AS lo, quantile_cont(v, 0.9::DOUBLE) AS hi, any_value(truth) AS truth FROM
          (SELECT area, vec_id % 9 + 1 AS block, i, avg(v) AS v, any_value(truth) AS truth FROM long_draws GROUP BY 1, 2, 3) GROUP BY area, block)) GROUP BY part""",
       rnd="bias mse coverage width")
def _(spark, sf):
    d = V.draws(spark, sf).withColumns({"block": F.col("vec_id") % 9 + 1, "one": F.lit(1.0)})
    b = Po.areal_draws(d, ["area", "truth", "block"], "one", "draws")
    part = F.explode(F.array(F.lit("all"), F.when(F.col("block") == 5, "centre").otherwise("others"))).alias("part")
    s = Sc.score_agg(b.select("*", part), ["part"], truth="truth", draws="draws")
    return s.select("part", "bias", "mse", "coverage", "width")


@query("d09_urban_threshold", "pixels", "SELECT county, threshold FROM thresh", ctes=THRESH, rnd="threshold")
def _(spark, sf):
    t = Ar.urban_threshold(V.pixels(spark, sf), "county", "pop", "pixel", "pct_urban", ("NATION_1", "NATION_2"))
    return t.select("county", "threshold")


@query("d10_urban_share", "pixels", """
    SELECT county, count(*) FILTER (WHERE pop > threshold) AS n_urban, count(*) AS n FROM pixels JOIN thresh USING (county) GROUP BY county""", ctes=THRESH)
def _(spark, sf):
    p = V.pixels(spark, sf).drop("urban")
    t = Ar.urban_threshold(p, "county", "pop", "pixel", "pct_urban", ("NATION_1", "NATION_2"))
    return Ar.urban_flag(p, t, "county", "pop").groupBy("county").agg(
        F.count(F.when(F.col("urban"), 1)).alias("n_urban"), F.count(F.lit(1)).alias("n"))


GRID_POP = AREA_HITS + """,
    raster AS (SELECT id, CASE WHEN count(value) = 4 THEN sum(w * value) END AS pop FROM (
      SELECT id, bx + dx AS ix, by0 + dy AS iy, (CASE WHEN dx = 0 THEN 1 - tx ELSE tx END) * (CASE WHEN dy = 0 THEN 1 - ty ELSE ty END) AS w
      FROM (SELECT id, floor(east) AS bx, floor(north) AS by0, east - floor(east) AS tx, north - floor(north) AS ty FROM points),
        (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)) LEFT JOIN grid USING (ix, iy) GROUP BY id),
    cells AS (SELECT id, area, pop, (area % 5 + 1) / 10e0 AS pct FROM found JOIN raster USING (id) WHERE pop IS NOT NULL),
    sums AS (SELECT *, sum(pop) OVER (PARTITION BY area ORDER BY pop, id ROWS UNBOUNDED PRECEDING) AS cum, sum(pop) OVER (PARTITION BY area) AS total FROM cells),
    limits AS (SELECT area, min(pop) FILTER (WHERE cum >= total * (1 - pct)) AS threshold FROM sums GROUP BY area)"""


@query("d11_population_grid", "points edges grid", "SELECT id, area, pop, threshold, pop > threshold AS urban FROM cells JOIN limits USING (area)",
       rnd="pop threshold", digits=9, ctes=GRID_POP)
def _(spark, sf):
    # Grid cells inside an area get the population of the raster, then the area's threshold and flag.
    cells = V.points(spark, sf).select("id", "east", "north")
    inside = Sp.assign_area(cells, V.rings(spark, sf), "id").where("n_areas > 0").select("id", "area")
    pop = Sp.raster_extract(cells, V.grid(spark, sf), "id", "east", "north", (0.0, 0.0), (1.0, 1.0))
    g = inside.join(pop, "id").where("value IS NOT NULL").select("id", "area", F.col("value").alias("pop"))
    # Stored, as the threshold and the flag both read it.
    g = written(g.withColumn("pct_urban", (F.col("area") % 5 + 1) / 10.0))
    t = Ar.urban_threshold(g, "area", "pop", "id", "pct_urban")
    return Ar.urban_flag(g, t, "area", "pop").select("id", "area", "pop", "threshold", "urban")


TARGETS = """
    targets AS (SELECT county, urban, count(*) * avg(n) * avg(truth * 1.0123456789::DOUBLE) AS target FROM obs GROUP BY county, urban)"""


@query("d12_rescale_population", "pixels obs", """
    SELECT pixel, pop * CASE WHEN total > 0 THEN target / total ELSE 0 END AS pop_adjusted FROM
      (SELECT *, sum(pop) OVER (PARTITION BY county, urban) AS total FROM pixels) LEFT JOIN targets USING (county, urban)""", rnd="pop_adjusted", ctes=TARGETS, digits=4)
def _(spark, sf):
    t = Ar.stratum_targets(V.obs(spark, sf).withColumn("persons", F.col("truth") * F.lit(1.0123456789)), ["county", "urban"], "n", "persons")
    return Ar.rescale_population(V.pixels(spark, sf), t, ["county", "urban"], "pop").select("pixel", "pop_adjusted")


@query("d13_stratum_targets", "obs", "SELECT * FROM targets", rnd="target", ctes=TARGETS, digits=4)
def _(spark, sf):
    return Ar.stratum_targets(V.obs(spark, sf).withColumn("persons", F.col("truth") * F.lit(1.0123456789)), ["county", "urban"], "n", "persons")


@query("d14_area_truth", "obs", "SELECT region, county, sum(quality + 1) / CAST(sum(n) AS DOUBLE) AS truth FROM obs GROUP BY region, county", rnd="truth")
def _(spark, sf):
    o = V.obs(spark, sf).withColumn("y", F.col("quality") + 1)
    return Ar.area_truth(o, ["region", "county"], "y", "n")


@query("d15_curve_summary", "long_draws", """
    SELECT i AS step, avg(v) AS mean, quantile_cont(v, 0.1::DOUBLE) AS lower, quantile_cont(v, 0.9::DOUBLE) AS upper FROM long_draws GROUP BY i""",
       rnd="mean lower upper", ints="step")
def _(spark, sf):
    return Po.curve_summary(long_draws(spark, sf).withColumnRenamed("i", "step"), ["step"], "v", "vec_id")


CURVES = """curves AS (SELECT p_partkey, d, exp(-d / (p_size / 3e0)) AS cor FROM part, range(1, 41) t(d))"""


def curves(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("d"))
    return p.withColumn("cor", F.exp(-F.col("d") / (F.col("p_size") / 3.0)))


@query("d16_effective_range", sql="""
    SELECT p_partkey, coalesce(min(d) FILTER (WHERE cor <= 0.1::DOUBLE), max(d)) AS effective_range, count(*) FILTER (WHERE cor <= 0.1::DOUBLE) = 0 AS beyond
    FROM curves GROUP BY p_partkey""", ints="effective_range", ctes=CURVES)
def _(spark, sf):
    return Po.effective_range(curves(spark, sf), ["p_partkey"], "d", "cor")


CUM = """cum AS (SELECT *, sum(w) OVER (PARTITION BY area ORDER BY v, vec_id * 100 + i ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY area) AS share FROM long_draws)"""


@query("d17_weighted_quantiles", "long_draws", """
    SELECT area, min(v) FILTER (WHERE share + 1e-12 >= 0.025::DOUBLE) AS q_lower, min(v) FILTER (WHERE share + 1e-12 >= 0.5::DOUBLE) AS q50,
      min(v) FILTER (WHERE share + 1e-12 >= 0.975::DOUBLE) AS q_upper FROM cum GROUP BY area""", rnd="q_lower q50 q_upper", ints="area", ctes=CUM)
def _(spark, sf):
    d = long_draws(spark, sf).withColumn("atom", F.col("vec_id") * 100 + F.col("i"))
    return Po.weighted_quantiles(d, ["area"], "v", "w", "atom", {"q_lower": 0.025, "q50": 0.5, "q_upper": 0.975})


VARIO = """
    vg AS (SELECT dx, dy, count(*) AS n, avg((b.value - a.value) * (b.value - a.value)) AS gamma FROM grid a, range(7) x(dx), range(7) y(dy), grid b
      WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY dx, dy)"""


@query("d18_grid_variogram", "grid", "SELECT dx, dy, n, gamma FROM vg", rnd="gamma", ints="dx dy", ctes=VARIO)
def _(spark, sf):
    return Sp.variogram(V.grid(spark, sf), LAGS)


DIRECTED = """
    lagged AS (SELECT dx, dy, count(*) AS n, avg((b.value - a.value) * (b.value - a.value)) AS gamma FROM grid a, range(1, 9) x(dx), range(1, 9) y(dy), grid b
      WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY dx, dy),
    directed AS (SELECT 1 AS direction, dx * 0.5::DOUBLE AS h, * FROM lagged WHERE dy = 1 AND dx <= 6
      UNION ALL SELECT 2, sqrt((dx * 0.5::DOUBLE) * (dx * 0.5::DOUBLE) + (dy * 0.8::DOUBLE) * (dy * 0.8::DOUBLE)), * FROM lagged WHERE (dx, dy) IN ((3, 2), (5, 3), (7, 4))
      UNION ALL SELECT 3, sqrt((dx * 0.5::DOUBLE) * (dx * 0.5::DOUBLE) + (dy * 0.8::DOUBLE) * (dy * 0.8::DOUBLE)), * FROM lagged WHERE dx = dy AND dx <= 6
      UNION ALL SELECT 4, sqrt((dx * 0.5::DOUBLE) * (dx * 0.5::DOUBLE) + (dy * 0.8::DOUBLE) * (dy * 0.8::DOUBLE)), * FROM lagged WHERE (dx, dy) IN ((2, 3), (3, 5), (4, 7))
      UNION ALL SELECT 5, dy * 0.8::DOUBLE, * FROM lagged WHERE dx = 1 AND dy <= 6)"""
SQUARE = [(dx, dy) for dx in range(1, 9) for dy in range(1, 9)]


@query("d19_directional_variogram", "grid", "SELECT direction, dx, dy, n, gamma, h FROM directed", rnd="gamma h", ints="dx dy direction", ctes=DIRECTED)
def _(spark, sf):
    return Sp.directional_variogram(Sp.variogram(V.grid(spark, sf), SQUARE), 8, 8, 0.5, 0.8)


@query("d20_simulation_se", "long_draws", "SELECT vec_id, sqrt(var_samp(v) + 0.25::DOUBLE) AS se FROM long_draws GROUP BY vec_id", rnd="se")
def _(spark, sf):
    return Po.simulation_se(V.draws(spark, sf), "draws", 0.5).select("vec_id", "se")


@query("d21_prediction_ranges", "single", """
    SELECT min(est) AS est_min, max(est) AS est_max, min(width) AS width_min, max(width) AS width_max FROM single""", rnd="est_min est_max width_min width_max")
def _(spark, sf):
    return V.single(spark, sf).agg(F.min("est").alias("est_min"), F.max("est").alias("est_max"), F.min("width").alias("width_min"), F.max("width").alias("width_max"))


@query("d22_level_summary_lines", "single", """
    SELECT 'region' AS level, model, max(est) - min(est) AS est_range, any_value(w) AS median_width FROM (SELECT model, region, avg(est) AS est FROM single GROUP BY model, region)
      JOIN (SELECT model, median(width) AS w FROM single GROUP BY model) USING (model) GROUP BY model
    UNION ALL SELECT 'county', model, max(est) - min(est), any_value(w) FROM (SELECT model, county, avg(est) AS est FROM single GROUP BY model, county)
      JOIN (SELECT model, median(width) AS w FROM single GROUP BY model) USING (model) GROUP BY model""", rnd="est_range median_width")
def _(spark, sf):
    s = V.single(spark, sf).select("id", "model", "region", "county", "est", "width")
    width = group_quantiles(s, ["model"], "width", "id", {"median_width": 0.5}).drop("n")

    def level(name):
        return s.groupBy("model", name).agg(F.avg("est").alias("est")).groupBy("model").agg(
            (F.max("est") - F.min("est")).alias("est_range")).withColumn("level", F.lit(name))

    return level("region").unionByName(level("county")).join(width, "model")


BOX = "box AS (SELECT region, min(east) AS x_min, max(east) AS x_max, min(north) AS y_min, max(north) AS y_max, count(*) AS n_min FROM obs GROUP BY region)"
SIZES = """SELECT *, nx * ny AS n_knots, width * 2.5::DOUBLE AS theta FROM (SELECT *, CAST(floor((x_max - x_min) / width + 1e-9) AS BIGINT) + 1 + {b2} AS nx,
    CAST(floor((y_max - y_min) / width + 1e-9) AS BIGINT) + 1 + {b2} AS ny FROM (SELECT *, greatest(x_max - x_min, y_max - y_min) / ((1 << (layer - 1)) * (nc - 1)) AS width
    FROM ({src})))"""


def boxes(spark, sf):
    return V.obs(spark, sf).groupBy("region").agg(
        F.min("east").alias("x_min"), F.max("east").alias("x_max"), F.min("north").alias("y_min"), F.max("north").alias("y_max"), F.count(F.lit(1)).alias("n_min"))


@query("d23_lattice_sizes", "obs", "SELECT region, layer, nx, ny, n_knots, width, theta FROM (" + SIZES.format(
    b2=10, src="SELECT box.*, 10 AS nc, unnest([1, 2, 3]) AS layer FROM box") + ")", rnd="width theta", ints="layer", ctes=BOX)
def _(spark, sf):
    return lattice_sizes(boxes(spark, sf), 10).select("region", "layer", "nx", "ny", "n_knots", "width", "theta")


@query("d24_smallest_lattice", "obs", """
    SELECT region, n_min, min(nc) AS nc, min(knots) AS knots FROM (SELECT region, n_min, nc, CAST(sum(n_knots) AS BIGINT) AS knots FROM (""" + SIZES.format(
    b2=10, src="SELECT box.*, nc, unnest([1, 2, 3]) AS layer FROM box, range(2, 300) t(nc) WHERE nc >= ceil(2 * greatest(x_max - x_min, y_max - y_min) / least(x_max - x_min, y_max - y_min))")
    + ") GROUP BY region, n_min, nc) WHERE knots >= n_min GROUP BY region, n_min", ctes=BOX)
def _(spark, sf):
    return smallest_lattice(boxes(spark, sf), ["region"], "n_min")


@query("d25_covariate_knots", "points", """
    SELECT 'even' AS kind, i AS knot, lo + (i - 1) * ((hi - lo) / 10) AS position FROM range(1, 12) t(i), (SELECT min(truth) AS lo, max(truth) AS hi FROM points)
    """ + " ".join(f"UNION ALL SELECT 'quantiles', {i + 1}, quantile_cont(truth, {i / 10!r}::DOUBLE) FROM points" for i in range(11)), rnd="position")
def _(spark, sf):
    p = V.points(spark, sf)
    even = Ar.covariate_knots(p, "truth", "id", 11).select(F.lit("even").alias("kind"), "knot", "position")
    quant = Ar.covariate_knots(p, "truth", "id", 11, quantiles=True).select(F.lit("quantiles").alias("kind"), "knot", "position")
    return even.unionByName(quant)


@query("d26_domain_box", "obs", """
    SELECT region, min(east) AS x_min, max(east) AS x_max, min(north) AS y_min, max(north) AS y_max, avg(east) AS x_mean, avg(north) AS y_mean FROM obs GROUP BY region""",
       rnd="x_min x_max y_min y_max x_mean y_mean")
def _(spark, sf):
    return Ar.domain_box(V.obs(spark, sf), "east", "north", ["region"])


@query("d27_convex_hull", "points", """
    WITH RECURSIVE pts AS (SELECT DISTINCT round(east * 100) AS x, round(north * 100) AS y FROM points WHERE east IS NOT NULL AND north IS NOT NULL),
    wrap AS (SELECT 1::BIGINT AS vertex, x, y, -pi() / 2 AS dir, x AS x0, y AS y0 FROM (SELECT x, y FROM pts ORDER BY x, y LIMIT 1)
      UNION ALL
      SELECT vertex + 1, n.x, n.y, atan2(n.y - w.y, n.x - w.x), x0, y0 FROM
        (SELECT any_value(vertex) AS vertex, any_value(x) AS x, any_value(y) AS y, any_value(x0) AS x0, any_value(y0) AS y0,
           arg_min({'x': px, 'y': py}, {'turn': turn, 'far': -far}) AS n FROM
          (SELECT w.*, p.x AS px, p.y AS py, (p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y) AS far,
             round(atan2(p.y - w.y, p.x - w.x) - dir + CASE WHEN round(atan2(p.y - w.y, p.x - w.x) - dir, 10) < 0 THEN 2 * pi() ELSE 0 END, 10) AS turn
           FROM wrap w JOIN pts p ON p.x <> w.x OR p.y <> w.y)) w
      WHERE n IS NOT NULL AND (n.x <> x0 OR n.y <> y0))
    SELECT vertex, x / 100 AS x, y / 100 AS y FROM wrap""", rnd="x y")
def _(spark, sf):
    # Whole hundredths, in which turns are exact and points on an edge are told from vertices.
    p = V.points(spark, sf).select(*[F.round(F.col(c) * 100).alias(c) for c in ("east", "north")])
    return Ar.convex_hull(p, "east", "north").select("vertex", F.col("x") / 100, F.col("y") / 100).toDF("vertex", "x", "y")


@query("d28_polygon_metrics", "rings edges", """
    SELECT area, ring_id, ring_area, radius, mean_centre_dist, row_number() OVER (PARTITION BY area ORDER BY ring_area DESC, ring_id) = 1 AS largest FROM
      (SELECT area, ring_id, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS ring_area, avg(sqrt((a.x - cx) * (a.x - cx) + (a.y - cy) * (a.y - cy))) AS mean_centre_dist
       FROM edges JOIN (SELECT area, ring_id, avg(a.x) AS cx, avg(a.y) AS cy FROM edges GROUP BY area, ring_id) USING (area, ring_id) GROUP BY area, ring_id)
    JOIN (SELECT p.area, p.ring_id, max(sqrt((p.a.x - q.a.x) * (p.a.x - q.a.x) + (p.a.y - q.a.y) * (p.a.y - q.a.y))) / 2 AS radius
       FROM edges p JOIN edges q ON p.area = q.area AND p.ring_id = q.ring_id GROUP BY p.area, p.ring_id) USING (area, ring_id)""",
       rnd="ring_area radius mean_centre_dist", ints="ring_id")
def _(spark, sf):
    return Ar.polygon_metrics(V.rings(spark, sf))


@query("d29_cluster_counts", "points", f"""
    SELECT block, count(*) AS n, min(north) AS low, max(north) AS high FROM (SELECT id, north, i AS block, row_number() OVER (PARTITION BY id ORDER BY (east - cx) * (east - cx) + (north - cy) * (north - cy), i) AS r
      FROM points, (SELECT unnest(range(1, 26)) AS i, unnest({[c[0] for c in CENTROIDS]}::DOUBLE[]) AS cx, unnest({[c[1] for c in CENTROIDS]}::DOUBLE[]) AS cy)) WHERE r = 1 GROUP BY block""", rnd="low high")
def _(spark, sf):
    p = V.points(spark, sf).withColumn("block", Sp.nearest_centroid("east", "north", CENTROIDS))
    return p.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("north").alias("low"), F.max("north").alias("high"))


@query("d30_effect_curve", "long_draws draws", """
    SELECT i AS knot, avg(e) AS mean, quantile_cont(e, 0.1::DOUBLE) AS lower, quantile_cont(e, 0.9::DOUBLE) AS upper FROM
      (SELECT i, 100 * (exp(v / 100 + draws[1] / 100 * (i / 64e0)) - 1) AS e FROM long_draws JOIN draws USING (vec_id)) GROUP BY i""",
       rnd="mean lower upper", ints="knot")
def _(spark, sf):
    d = V.draws(spark, sf).select("vec_id", (F.col("draws")[0] / 100).alias("slope"), F.posexplode("draws").alias("pos", "v"))
    params = d.select("vec_id", "slope", (F.col("pos") + 1).alias("knot"), (F.col("v") / 100).alias("walk"))
    knots = params.select("knot").distinct().withColumn("knot_value", F.col("knot") / 64.0)
    return Po.effect_curve(params, knots, [], "walk", "slope", "vec_id", percent=True)


PROBS = "list_transform(draws, lambda v: 1e0 / (1e0 + exp(-v)))"
STATES = Po.noise_ctes(f"SELECT vec_id, area, 5 + vec_id % 20 AS n, {PROBS} AS p FROM draws", "vec_id", 7)


def _lists(value: str, source: str = "states") -> str:
    return f"SELECT vec_id, area, list(round({value}, 6) ORDER BY i) AS draws FROM {source} GROUP BY vec_id, area"


NOISE = {
    "n01_binomial_noise": ({"family": "binomial", "size": "n"}, _lists("hits / n", f"""
      (SELECT vec_id, area, i, any_value(n)::DOUBLE AS n, count(*) FILTER (u < v) AS hits FROM
        (SELECT *, {Po.uniform_sql('a', 'b', 't')} AS u FROM states, range(1, 25) AS r(t) WHERE t <= n) GROUP BY vec_id, area, i)"""), STATES),
    "n02_gaussian_noise": ({"family": "gaussian", "var": "nugget"}, _lists(f"v + {Po.normal_sql('0')} * sqrt(0.25::DOUBLE)"), STATES),
    "n03_beta_noise": ({"family": "beta", "rho": 0.1}, _lists("x.g / (x.g + y.g)", "first x JOIN second y USING (vec_id, i, area)"),
                       f"{STATES}, {Po.gamma_ctes('first', 'greatest(v * 9e0, 1e-12)', 0)}, {Po.gamma_ctes('second', 'greatest((1e0 - v) * 9e0, 1e-12)', Po.SECOND)}"),
    "n04_gamma_noise": ({"family": "gamma", "dispersion": 0.2}, _lists("g * v * 0.2::DOUBLE", "drawn"), f"{STATES}, {Po.gamma_ctes('drawn', '5e0', 0)}"),
}


for _family, (_kw, _sql, _ctes) in NOISE.items():
    def _noise(spark, sf, kw=_kw):
        d = V.draws(spark, sf).withColumns({
            "draws": F.transform("draws", lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))), "n": 5 + F.col("vec_id") % 20,
            "nugget": F.lit(0.25)})
        noisy = Po.add_noise(d, "vec_id", "draws", seed=7, **kw)
        return noisy.select("vec_id", "area", F.transform("noisy", lambda v: F.round(v, 6)).alias("draws"))
    query(_family, "draws", _sql, ints="area", ctes=_ctes)(_noise)
