"""Queries for joins: lookups, areas, neighbours, rasters, bases (J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import areal as Ar
from ..operators import spatial as Sp
from ..operators.compare import pair_models
from ..operators.lattice import basis_entries, lattice, sparse_apply
from ..operators.sampling import task_grid
from . import views as V
from .q_scans import AREA_HITS
from .registry import query

LAYERS = lattice((0.0, 100.06), (0.0, 100.08), nc=6, n_buffer=2, n_layer=2)
CENTROIDS = [(10.0 + 20 * i, 10.0 + 20 * j) for i in range(5) for j in range(5)]
DIST = "sqrt((a.east - b.east) * (a.east - b.east) + (a.north - b.north) * (a.north - b.north))"


@query("j01_area_to_region", "obs", """
    SELECT id, o.county, r_name AS region FROM obs o LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7)
    ON county = n_name""")
def _(spark, sf):
    n, r = V.table(spark, sf, "nation").where("n_nationkey <> 7"), V.table(spark, sf, "region")
    # First match per name: the lookup is made unique before it is joined.
    look = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("n_name").alias("county")).agg(
        F.min(F.struct("n_nationkey", "r_name"))["r_name"].alias("region"))
    return V.obs(spark, sf).select("id", "county").join(look, "county", "left").select("id", "county", "region")


THRESH = """
    cums AS (SELECT *, sum(pop) OVER (PARTITION BY county ORDER BY pop, pixel ROWS UNBOUNDED PRECEDING) AS cum, sum(pop) OVER (PARTITION BY county) AS total FROM pixels),
    thresh AS (SELECT county, CASE WHEN county IN ('NATION_1', 'NATION_2') THEN '-Infinity'::DOUBLE
      ELSE CAST(min(pop) FILTER (WHERE cum >= total * (1 - pct_urban)) AS DOUBLE) END AS threshold FROM cums GROUP BY county)"""


@query("j02_pixel_threshold", "pixels", """
    SELECT pixel, pop, pop > threshold AS urban FROM pixels LEFT JOIN (SELECT * FROM thresh WHERE county <> 'NATION_3') t USING (county)""", ctes=THRESH)
def _(spark, sf):
    p = V.pixels(spark, sf).drop("urban")
    t = Ar.urban_threshold(p, "county", "pop", "pixel", "pct_urban", ("NATION_1", "NATION_2")).where("county <> 'NATION_3'")
    return Ar.urban_flag(p, t, "county", "pop").select("pixel", "pop", "urban")


@query("j03_point_in_polygon", "points edges", """
    SELECT id, area, coalesce(n_areas, 0) AS n_areas, coalesce(n_areas, 0) > 1 AS several FROM points LEFT JOIN found USING (id)""", ctes=AREA_HITS)
def _(spark, sf):
    return Sp.assign_area(V.points(spark, sf), V.rings(spark, sf), "id")


@query("j04_prediction_and_truth", "points preds", """
    SELECT p.id, q.model, p.truth, q.est FROM points p JOIN (SELECT east, north, model, est FROM preds) q USING (east, north)""", rnd="truth est")
def _(spark, sf):
    q = V.preds(spark, sf).select("east", "north", "model", "est")
    return V.points(spark, sf).join(q, ["east", "north"]).select("id", "model", "truth", "est")


NEAREST = f"""
    ranked AS (SELECT a.id, b.id AS rid, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS r
      FROM points a, points b WHERE a.role = 'test' AND b.role = 'train')"""


def split(spark, sf):
    p = V.points(spark, sf)
    return p.where("role = 'test'"), p.where("role = 'train'")


@query("j05_nearest_observation", "points", "SELECT id, rid, d FROM ranked WHERE r = 1", rnd="d", ctes=NEAREST)
def _(spark, sf):
    test, train = split(spark, sf)
    return Sp.nearest(test, train, "id", "id").select("id", "rid", "d")


@query("j06_within_radius", "points", "SELECT a.id, rid, d FROM (SELECT id FROM points WHERE role = 'test') a LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND d <= 0.2::DOUBLE) USING (id)",
       rnd="d", ctes=NEAREST)
def _(spark, sf):
    test, train = split(spark, sf)
    return Sp.within_radius(test, train, "id", "id", 0.2)


@query("j07_stratified_distances", "points", f"""
    SELECT a.id, a.urban, min({DIST}) AS nn_all, min({DIST}) FILTER (WHERE b.urban) AS nn_urban, min({DIST}) FILTER (WHERE NOT b.urban) AS nn_rural
    FROM points a, points b WHERE {DIST} > 0 GROUP BY a.id, a.urban""", rnd="nn_all nn_urban nn_rural")
def _(spark, sf):
    p = V.points(spark, sf)
    return Sp.stratified_nearest(p, p, "id", "id")


@query("j08_nearest_centroid", "points", f"""
    SELECT id, block FROM (SELECT id, i AS block, row_number() OVER (PARTITION BY id ORDER BY (east - cx) * (east - cx) + (north - cy) * (north - cy), i) AS r
      FROM points, (SELECT unnest(range(1, 26)) AS i, unnest({[c[0] for c in CENTROIDS]}::DOUBLE[]) AS cx, unnest({[c[1] for c in CENTROIDS]}::DOUBLE[]) AS cy)) WHERE r = 1""")
def _(spark, sf):
    return V.points(spark, sf).select("id", Sp.nearest_centroid("east", "north", CENTROIDS).alias("block"))


@query("j09_k_nearest", "points", "SELECT id, rid, d, r AS rank FROM ranked WHERE r <= 15", rnd="d", ctes=NEAREST)
def _(spark, sf):
    test, train = split(spark, sf)
    return Sp.nearest(test, train, "id", "id", k=15).select("id", "rid", "d", "rank")


@query("j09_preceding_neighbours", "pixels", f"""
    SELECT pixel, rid, d, r AS rank FROM (SELECT a.pixel, b.pixel AS rid, {DIST} AS d, row_number() OVER (PARTITION BY a.pixel ORDER BY {DIST}, b.pixel) AS r
      FROM pixels a, pixels b WHERE b.pixel < a.pixel) WHERE r <= 5""", rnd="d")
def _(spark, sf):
    return Sp.preceding_neighbours(V.pixels(spark, sf), "pixel", "east", "north", 5)


@query("j10_bilinear_raster", "points grid", """
    SELECT id, CASE WHEN count(value) = 4 THEN sum(w * value) END AS value FROM (
      SELECT id, bx + dx AS ix, by0 + dy AS iy, (CASE WHEN dx = 0 THEN 1 - tx ELSE tx END) * (CASE WHEN dy = 0 THEN 1 - ty ELSE ty END) AS w
      FROM (SELECT id, floor(fx) AS bx, floor(fy) AS by0, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM (SELECT id, east / 1.1::DOUBLE AS fx, (north + 3) / 0.9::DOUBLE AS fy FROM points)),
        (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)) LEFT JOIN grid USING (ix, iy) GROUP BY id""", rnd="value")
def _(spark, sf):
    return Sp.raster_extract(V.points(spark, sf), V.grid(spark, sf), "id", "east", "north", (0.0, -3.0), (1.1, 0.9))


@query("j11_rasterise", "points", """
    SELECT CAST(floor(east / 2.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor((north - 1) / 2e0 + 0.5::DOUBLE) AS BIGINT) AS iy, count(*) AS n, avg(truth) AS value
    FROM points GROUP BY 1, 2""", rnd="value", digits=9)
def _(spark, sf):
    return Sp.rasterise(V.points(spark, sf), "east", "north", "truth", (0.0, 1.0), (2.5, 2.0))


@query("j12_containing_cell", "points grid", """
    SELECT id, value FROM (SELECT id, floor(east / 1.1::DOUBLE + 0.5::DOUBLE) AS ix, floor((north + 3) / 0.9::DOUBLE + 0.5::DOUBLE) AS iy FROM points)
    LEFT JOIN grid USING (ix, iy)""", rnd="value")
def _(spark, sf):
    return Sp.raster_extract(V.points(spark, sf), V.grid(spark, sf), "id", "east", "north", (0.0, -3.0), (1.1, 0.9), "simple")


@query("j13_fan_out_to_pixels", "pixels preds", """
    SELECT pixel, county, urban, coalesce(CASE WHEN urban THEN u.est END, r.est) AS est FROM pixels
    LEFT JOIN (SELECT county, avg(est) AS est FROM preds WHERE NOT urban GROUP BY county) r USING (county)
    LEFT JOIN (SELECT county, avg(est) AS est FROM preds WHERE urban AND county <> 'NATION_4' GROUP BY county) u USING (county)""", rnd="est", digits=9)
def _(spark, sf):
    p = V.preds(spark, sf)
    r = p.where("NOT urban").groupBy("county").agg(F.avg("est").alias("est"))
    u = p.where("urban AND county <> 'NATION_4'").groupBy("county").agg(F.avg("est").alias("est"))
    return Ar.fan_out(V.pixels(spark, sf), r, u, "county", "est").select("pixel", "county", "urban", "est")


@query("j14_not_sampled", "points", "SELECT id, truth FROM points WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)", rnd="truth")
def _(spark, sf):
    taken = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    return V.points(spark, sf).join(taken, "id", "left_anti").select("id", "truth")


@query("j15_units_in_truth", "points", "SELECT id, truth FROM points WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", rnd="truth")
def _(spark, sf):
    known = V.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return V.points(spark, sf).join(known, "id", "left_semi").select("id", "truth")


@query("j16_prediction_axes", "obs", """
    SELECT county, ix, iy, x0 + ix * (x1 - x0) / 9 AS x, y0 + iy * (y1 - y0) / 4 AS y FROM
      (SELECT county, min(east) AS x0, max(east) AS x1, min(north) AS y0, max(north) AS y1 FROM obs GROUP BY county), range(10) a(ix), range(5) b(iy)""", rnd="x y")
def _(spark, sf):
    box = Ar.domain_box(V.obs(spark, sf), "east", "north", ["county"])
    g = task_grid({"ix": list(range(10)), "iy": list(range(5))}, box)
    return g.select("county", "ix", "iy", (F.col("x_min") + F.col("ix") * (F.col("x_max") - F.col("x_min")) / 9).alias("x"),
                    (F.col("y_min") + F.col("iy") * (F.col("y_max") - F.col("y_min")) / 4).alias("y"))


ENTRIES = "entries AS (SELECT id, layer, kx * ny + ky AS knot, pow(1 - s, 6) * (35 * s * s + 18 * s + 3) / 3 AS a FROM (" + " UNION ALL ".join(
    f"""SELECT id, {l.layer} AS layer, kx, ky, {l.ny} AS ny, sqrt((east - x) * (east - x) + (north - y) * (north - y)) / ({l.width!r}::DOUBLE * 2.5::DOUBLE) AS s
    FROM points, (SELECT kx, {l.x0!r}::DOUBLE + kx * {l.width!r}::DOUBLE AS x FROM range({l.nx}) t(kx)), (SELECT ky, {l.y0!r}::DOUBLE + ky * {l.width!r}::DOUBLE AS y FROM range({l.ny}) t(ky))"""
    for l in LAYERS) + ") WHERE s < 1)"


@query("j17_basis_entries", "points", "SELECT id, layer, knot, a FROM entries WHERE a > 1e-9", rnd="a", ints="layer", ctes=ENTRIES)
def _(spark, sf):
    return basis_entries(V.points(spark, sf), LAYERS, "id", "east", "north").where("a > 1e-9")


LAGS = [(dx, dy) for dx in range(0, 7) for dy in range(0, 7)]


@query("j18_grid_lags", "grid", """
    SELECT a.ix, a.iy, b.ix - a.ix AS dx, b.iy - a.iy AS dy, a.value AS v0, b.value AS v1 FROM grid a JOIN grid b
    ON b.ix = a.ix + 2 AND b.iy = a.iy + 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL
    UNION ALL SELECT a.ix, a.iy, 0, 3, a.value, b.value FROM grid a JOIN grid b ON b.ix = a.ix AND b.iy = a.iy + 3 WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
       rnd="v0 v1", ints="dx dy")
def _(spark, sf):
    return Sp.grid_lags(V.grid(spark, sf), [(2, 1), (0, 3)])


@query("j19_pair_models", "preds", """
    SELECT id, max(est) FILTER (WHERE model = 'A') AS a, max(est) FILTER (WHERE model = 'B') AS b, max(est) FILTER (WHERE model = 'C') AS c FROM preds GROUP BY id""",
       rnd="a b c")
def _(spark, sf):
    return pair_models(V.preds(spark, sf).withColumn("model", F.lower("model")), ["id"], "model", "est", ["a", "b", "c"])


@query("j20_area_per_observation", "pixels obs", """
    SELECT county, size, n_obs, ln(size) - ln(n_obs) AS area_per_obs FROM (SELECT county, CAST(sum(pop) AS DOUBLE) AS size FROM pixels GROUP BY county)
    JOIN (SELECT county, count(*) AS n_obs FROM obs GROUP BY county) USING (county)""", rnd="size area_per_obs")
def _(spark, sf):
    a = V.pixels(spark, sf).groupBy("county").agg(F.sum("pop").cast("double").alias("size"))
    return Ar.area_per_observation(a, V.obs(spark, sf), "county", "size")


def coefficients(spark, sf):
    """A coefficient per knot from the part table's prices, repeated over both layers."""
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("knot"), (F.col("p_retailprice") / 1000).alias("c"))
    return p.select("knot", "c", F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"))


@query("j21_basis_times_coefficients", "points", """SELECT id, coalesce(v, 0) AS value FROM points LEFT JOIN
    (SELECT id, sum(a * coalesce(p_retailprice, 0) / 1000) AS v FROM entries LEFT JOIN part ON p_partkey = knot GROUP BY id) USING (id)""",
       rnd="value", ctes=ENTRIES)
def _(spark, sf):
    p = V.points(spark, sf)
    return sparse_apply(basis_entries(p, LAYERS, "id", "east", "north"), coefficients(spark, sf), "id", points=p)


@query("d31_layer_contributions", "points", "SELECT id, layer, sum(a * coalesce(p_retailprice, 0) / 1000) AS value FROM entries LEFT JOIN part ON p_partkey = knot GROUP BY id, layer",
       rnd="value", ints="layer", ctes=ENTRIES)
def _(spark, sf):
    p = V.points(spark, sf)
    return sparse_apply(basis_entries(p, LAYERS, "id", "east", "north"), coefficients(spark, sf), "id", by_layer=True, points=p)
