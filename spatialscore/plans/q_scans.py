"""Queries for sources, filters, set operations and sampling (S, F, G, T, U)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.transforms import layer_weights
from ..operators import filters as Fl
from ..operators import sampling as Sm
from ..operators import spatial as Sp
from ..operators.ordering import portable_hash_sql
from ..session import ensure_checkpoint_dir
from ..sources import tables as Tb
from . import views as V
from .registry import query


def scratch(spark, name: str) -> str:
    """A new path in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("s01_load_observations", sql="SELECT o_orderkey, o_totalprice, o_orderdate FROM orders", rnd="o_totalprice")
def _(spark, sf):
    return Tb.read_observations(spark, f"{sf}/orders.parquet", "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz")


@query("s02_swath_files", sql="SELECT event_id, event_type, value, 'events.parquet' AS file_name FROM events", rnd="value")
def _(spark, sf):
    return Tb.read_swaths(spark, f"{sf}/events.parquet", "event_id bigint, event_type string, value double")


@query("s03_expand_pixels", "draws", """
    SELECT vec_id, area, i - 1 AS pixel, draw, 2 * draw AS twice
    FROM (SELECT vec_id, area, unnest(range(1, len(draws) + 1)) AS i, unnest(draws) AS draw FROM draws)""",
       rnd="draw twice", ints="area pixel")
def _(spark, sf):
    d = V.draws(spark, sf).select("vec_id", "area", F.col("draws").alias("draw"), F.transform("draws", lambda v: v * 2).alias("twice"))
    return Tb.expand_pixels(d, ["draw", "twice"])


@query("s04_flatten_matrix", "long_draws", """
    SELECT vec_id, (i - 1) // 8 AS ix, (i - 1) % 8 AS iy, v AS value, i - 1 AS cell_id FROM long_draws""",
       rnd="value", ints="ix iy cell_id")
def _(spark, sf):
    m = F.array(*[F.slice("draws", 8 * i + 1, 8) for i in range(8)])
    return Tb.flatten_matrix(V.draws(spark, sf).select("vec_id", m.alias("m")), "m")


@query("s05_csv_lookup", sql="SELECT c_custkey AS unit, c_mktsegment AS segment, c_acctbal AS balance FROM customer", rnd="balance")
def _(spark, sf):
    path = scratch(spark, "lookup")
    V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(path, header=True)
    return Tb.read_csv(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double", ["unit", "segment", "balance"])


@query("s06_whitespace_table", "points", "SELECT id, east, north FROM points", rnd="east north")
def _(spark, sf):
    path = scratch(spark, "blanks")
    p = V.points(spark, sf)
    p.select(F.concat(F.lit("  "), F.col("id").cast("string"), F.lit("   "), F.col("east").cast("string"), F.lit(" "),
                      F.col("north").cast("string")).alias("value")).write.text(path)
    spark.createDataFrame([("id  east north",)], "value string").write.mode("append").text(path)
    return Tb.read_whitespace(spark, path, "id bigint, east double, north double")


@query("s07_rekey_predictions", "points preds", """
    SELECT p.id, p.truth, q.est FROM points p LEFT JOIN (SELECT east, north, est FROM preds WHERE model = 'B' AND region <> 'ASIA') q
    ON p.east = q.east AND p.north = q.north""", rnd="truth est")
def _(spark, sf):
    method = V.preds(spark, sf).where("model = 'B' AND region <> 'ASIA'").select("east", "north", "est")
    return Tb.rekey(method, V.points(spark, sf), ["east", "north"]).select("id", "truth", "est")


@query("s08_partitioned_results", "preds", """
    SELECT model, fold AS variation, count(*) AS n, avg(est) AS mean_est FROM preds GROUP BY model, fold""", rnd="mean_est")
def _(spark, sf):
    path = scratch(spark, "results")
    Tb.write_results(V.preds(spark, sf).withColumnRenamed("fold", "variation"), path)
    back = spark.read.parquet(path)
    return back.groupBy("model", "variation").agg(F.count(F.lit(1)).alias("n"), F.avg("est").alias("mean_est"))


@query("s09_unfinished_tasks", "preds", """
    SELECT DISTINCT model, fold FROM preds WHERE NOT (model = 'A' OR (model = 'B' AND fold < 4))""")
def _(spark, sf):
    p = V.preds(spark, sf)
    path = scratch(spark, "finished")
    Tb.write_results(p.where("model = 'A' OR (model = 'B' AND fold < 4)"), path, keys=["model", "fold"])
    tasks = p.select("model", "fold").distinct()
    return Tb.unfinished(tasks, spark.read.parquet(path), ["model", "fold"])


@query("s10_compact_results", "draws", "SELECT vec_id, area, truth, w FROM draws", rnd="truth w", ints="area")
def _(spark, sf):
    path = scratch(spark, "compact")
    Tb.write_results(V.draws(spark, sf), path, keys=["area"], drop=["draws"])
    return spark.read.parquet(path)


@query("f01_quality", "swath", """
    SELECT id, quality, quality <> 2 AS not_bad, quality = 0 AS best FROM swath WHERE quality <= 1""")
def _(spark, sf):
    return V.swath(spark, sf).where(Fl.quality_ok("quality", "at_most_good")).select(
        "id", "quality", Fl.quality_ok("quality").alias("not_bad"), Fl.quality_ok("quality", "best").alias("best"))


@query("f02_bounding_box", "swath", """
    SELECT id, lon, lat, value FROM swath WHERE lon BETWEEN -120 AND -80.5 AND lat BETWEEN 25 AND 50""", rnd="lon lat value")
def _(spark, sf):
    return V.swath(spark, sf).where(Fl.in_box("lon", "lat", (-120, -80.5), (25, 50))).select("id", "lon", "lat", "value")


@query("f03_day_of_year", "swath", "SELECT id, ts FROM swath WHERE dayofyear(ts) = 12")
def _(spark, sf):
    return V.swath(spark, sf).where(Fl.on_day_of_year("ts", 12)).select("id", "ts")


AREA_HITS = """
    crossed AS (SELECT p.id, e.area, e.ring_id, sum(CASE WHEN (e.a.y > p.north) <> (e.b.y > p.north)
        AND p.east < e.a.x + (p.north - e.a.y) / (e.b.y - e.a.y) * (e.b.x - e.a.x) THEN 1 ELSE 0 END) % 2 AS inside
      FROM points p JOIN edges e ON TRUE GROUP BY p.id, e.area, e.ring_id),
    per_area AS (SELECT id, area FROM crossed WHERE inside = 1 GROUP BY id, area HAVING count(*) % 2 = 1),
    found AS (SELECT id, min(area) AS area, count(*) AS n_areas FROM per_area GROUP BY id)"""


@query("f04_in_any_polygon", "points edges", "SELECT id, truth FROM points WHERE id IN (SELECT id FROM found)", rnd="truth",
       ctes=AREA_HITS)
def _(spark, sf):
    return Sp.in_any_area(V.points(spark, sf), V.rings(spark, sf), "id").select("id", "truth")


@query("f05_outside_rectangles", "points", """
    SELECT id, east, north FROM points WHERE NOT ((east BETWEEN 10 AND 40 AND north BETWEEN 0 AND 55.5)
        OR (east BETWEEN 35 AND 60 AND north BETWEEN 50 AND 90))""", rnd="east north")
def _(spark, sf):
    return Fl.outside_boxes(V.points(spark, sf), "east", "north", [(10, 40, 0, 55.5), (35, 60, 50, 90)]).select("id", "east", "north")


@query("f06_train_and_target", "grid", """
    SELECT ix, iy, CASE WHEN value IS NOT NULL THEN 'train' WHEN truth IS NOT NULL THEN 'target' END AS role FROM grid""")
def _(spark, sf):
    return V.grid(spark, sf).select("ix", "iy", Fl.split_role("value", "truth").alias("role"))


@query("f07_external_mask", "grid", """
    SELECT g.ix, g.iy, CASE WHEN m.value IS NOT NULL THEN g.truth END AS truth FROM grid g
    LEFT JOIN grid m ON g.ix = m.iy AND g.iy = m.ix""", rnd="truth")
def _(spark, sf):
    g = V.grid(spark, sf)
    mask = g.select(F.col("iy").alias("ix"), F.col("ix").alias("iy"), "value")
    return Fl.apply_mask(g, mask, ["ix", "iy"], "truth", "value").select("ix", "iy", "truth")


@query("f08_sentinel_scale", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) * 0.02::DOUBLE + -273.15::DOUBLE AS kelvin FROM lineitem""", rnd="kelvin",
       ints="l_linenumber")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", Fl.from_sentinel("l_discount", 0.0, 0.02, -273.15).alias("kelvin"))


@query("f09_drop_missing_truth", "grid", "SELECT ix, iy, value FROM grid WHERE value IS NOT NULL", rnd="value")
def _(spark, sf):
    return V.grid(spark, sf).dropna(subset=["value"]).select("ix", "iy", "value")


@query("f10_drop_corner", "points", "SELECT id, truth FROM points WHERE NOT (east > 80 AND north > 70)", rnd="truth")
def _(spark, sf):
    return Fl.drop_corner(V.points(spark, sf), "east", "north", 80, 70).select("id", "truth")


@query("f11_distance_cutoff", "preds", "SELECT id, model, dist FROM preds WHERE dist < 5", rnd="dist")
def _(spark, sf):
    return V.preds(spark, sf).where(F.col("dist") < 5).select("id", "model", "dist")


@query("f12_prediction_subset", "preds", """
    SELECT 'urban' AS kept, count(*) AS n, avg(est) AS est FROM preds WHERE urban
    UNION ALL SELECT 'rural', count(*), avg(est) FROM preds WHERE NOT urban
    UNION ALL SELECT 'all', count(*), avg(est) FROM preds""", rnd="est")
def _(spark, sf):
    own = F.when(F.col("urban"), "urban").otherwise("rural")
    kept = V.preds(spark, sf).select("est", F.explode(F.array(F.lit("all"), own)).alias("kept"))
    return kept.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.avg("est").alias("est"))


@query("f13_grid_window", "grid", "SELECT ix, iy, truth FROM grid WHERE ix BETWEEN 20 AND 69 AND iy BETWEEN 10 AND 89", rnd="truth")
def _(spark, sf):
    return Fl.cell_window(V.grid(spark, sf), 20, 50, 10, 80).select("ix", "iy", "truth")


@query("f14_layers_with_weight", sql="""
    SELECT p_partkey, layer, alpha FROM (
      SELECT p_partkey, unnest([1, 2, 3]) AS layer, unnest(CASE WHEN p_size % 10 = 0 THEN [1e0, 0e0, 0e0] WHEN p_size % 10 = 1 THEN [1e0/3, 1e0/3, 1e0/3]
        ELSE list_transform([1, 2, 3], lambda l: pow(2e0, -2e0 * l * (p_size / 10e0)) /
          (pow(2e0, -2e0 * (p_size / 10e0)) + pow(2e0, -4e0 * (p_size / 10e0)) + pow(2e0, -6e0 * (p_size / 10e0)))) END) AS alpha FROM part) t
    WHERE alpha <> 0""", rnd="alpha", ints="layer")
def _(spark, sf):
    nu = F.when(F.col("p_size") % 10 == 0, F.lit(float("inf"))).when(F.col("p_size") % 10 == 1, F.lit(0.0)).otherwise(F.col("p_size") / 10.0)
    w = V.table(spark, sf, "part").select("p_partkey", F.posexplode(layer_weights(3, nu)).alias("layer", "alpha"))
    return Fl.nonzero_layers(w).withColumn("layer", F.col("layer") + 1)


@query("f15_select_models", "preds", """
    SELECT id, model, county FROM preds WHERE model IN ('A', 'C') AND NOT regexp_matches(county, 'NATION_1[0-9]?$')""")
def _(spark, sf):
    return V.preds(spark, sf).where(F.col("model").isin("A", "C") & ~F.col("county").rlike("NATION_1[0-9]?$")).select("id", "model", "county")


@query("f16_times_in_year", sql="""
    SELECT o_orderstatus, avg(CASE WHEN year(o_orderdate) = 1996 THEN 1e0 ELSE 0e0 END) AS share, min(o_orderdate) AS first,
    max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus""", rnd="share")
def _(spark, sf):
    return Fl.share_in_year(V.table(spark, sf, "orders"), "o_orderdate", 1996, ["o_orderstatus"])


# --- distinct, sorts, sets -----------------------------------------------------------------------

@query("g01_distinct_areas", "obs", "SELECT DISTINCT region, county FROM obs ORDER BY region, county")
def _(spark, sf):
    return V.obs(spark, sf).select("region", "county").distinct().orderBy("region", "county")


@query("g03_strata_frequency", "obs", "SELECT county || CASE WHEN urban THEN 'U' ELSE 'R' END AS stratum, count(*) AS n FROM obs GROUP BY 1")
def _(spark, sf):
    from ..functions.transforms import stratum_key
    return V.obs(spark, sf).groupBy(stratum_key("county", "urban").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("g04_fast_quantiles", digits=6)
def _(spark, sf):
    # The quick sketch next to the exact value, so that its error is visible.
    from ..operators.ordering import group_quantiles
    p = V.preds(spark, sf)
    quick = p.groupBy("model").agg(F.percentile_approx("est", 0.9, 10000).alias("approx_q90"))
    exact = group_quantiles(p, ["model"], "est", "id", {"exact_q90": 0.9}).drop("n")
    return quick.join(exact, "model").withColumn("error", F.col("approx_q90") - F.col("exact_q90"))


@query("t01_sort_by_distance", "preds", "SELECT id, model, dist FROM preds ORDER BY dist, id, model", rnd="dist")
def _(spark, sf):
    return V.preds(spark, sf).select("id", "model", "dist").orderBy("dist", "id", "model")


@query("t02_areas_by_name", "pixels obs", """
    SELECT county, pop, n_obs FROM (SELECT county, CAST(sum(pop) AS BIGINT) AS pop FROM pixels GROUP BY county)
    JOIN (SELECT county, count(*) AS n_obs FROM obs GROUP BY county) USING (county) ORDER BY county""")
def _(spark, sf):
    a = V.pixels(spark, sf).groupBy("county").agg(F.sum("pop").alias("pop"))
    return a.join(V.obs(spark, sf).groupBy("county").agg(F.count(F.lit(1)).alias("n_obs")), "county").orderBy("county")


@query("t03_arg_max", "points", """
    SELECT urban, id, truth FROM (SELECT *, row_number() OVER (PARTITION BY urban ORDER BY round(truth, 0) DESC, id) AS r FROM points) WHERE r = 1""",
       rnd="truth")
def _(spark, sf):
    from ..operators.compare import arg_max
    return arg_max(V.points(spark, sf).withColumn("v", F.round("truth", 0)), "v", "id", ["urban"]).select("urban", "id", "truth")


@query("t04_first_data_sets", sql="""
    SELECT l_partkey, l_linenumber AS dataset_id, l_quantity FROM lineitem WHERE l_linenumber <= 3""", rnd="l_quantity", ints="dataset_id")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").where(F.col("l_linenumber") <= 3).select(
        "l_partkey", F.col("l_linenumber").alias("dataset_id"), "l_quantity")


@query("t05_random_order", "points", f"""
    SELECT id, row_number() OVER (ORDER BY {portable_hash_sql('id', 7)}, id) AS position FROM points""")
def _(spark, sf):
    return Sm.random_order(V.points(spark, sf), "id", 7).select("id", "position")


@query("t06_pooled_rows_only", "single", """
    SELECT model, count(*) AS n, avg(err) AS bias FROM single GROUP BY model""", rnd="bias")
def _(spark, sf):
    from ..operators.strata import scores_by_subset
    return scores_by_subset(V.single(spark, sf), ["model"]).where("subset = 'Avg'").select("model", "n", "bias")


@query("u01_append_tables", "points pixels", """
    SELECT id, east, north, 'obs' AS source FROM points UNION ALL SELECT pixel, east, north, 'pixel' FROM pixels""", rnd="east north")
def _(spark, sf):
    a = V.points(spark, sf).select("id", "east", "north", F.lit("obs").alias("source"))
    b = V.pixels(spark, sf).select(F.lit("pixel").alias("source"), F.col("pixel").alias("id"), "north", "east")
    return Sm.stack([a, b])


@query("u02_append_with_missing", "points", "SELECT id, truth FROM points WHERE urban", rnd="truth")
def _(spark, sf):
    return Sm.stack([None, V.points(spark, sf).where("urban").select("id", "truth"), None])


SAMPLE = f"sampled AS (SELECT *, row_number() OVER (ORDER BY {portable_hash_sql('id', 11)}, id) AS rn, count(*) OVER () AS total FROM points)"


@query("u03_remaining_ids", "points", "SELECT id FROM sampled WHERE rn > 1000", ctes=SAMPLE)
def _(spark, sf):
    p = V.points(spark, sf)
    return Sm.remaining(p, Sm.hash_sample(p, "id", 1000, 11), ["id"]).select("id")


@query("u04_bin_centres", "preds", """
    SELECT DISTINCT floor(dist) + 0.5::DOUBLE AS centre FROM preds WHERE model = 'A' UNION
    SELECT DISTINCT floor(2 * dist) + 0.5::DOUBLE FROM preds WHERE model <> 'A'""", rnd="centre")
def _(spark, sf):
    p = V.preds(spark, sf)
    a = p.where("model = 'A'").select((F.floor("dist") + F.lit(0.5)).alias("centre"))
    b = p.where("model <> 'A'").select((F.floor(F.col("dist") * 2) + F.lit(0.5)).alias("centre"))
    return a.union(b).distinct()


@query("u05_simple_sample", "points", "SELECT id, truth FROM sampled WHERE rn <= 1000", rnd="truth", ctes=SAMPLE)
def _(spark, sf):
    return Sm.hash_sample(V.points(spark, sf), "id", 1000, 11).select("id", "truth")


FOLDS = f"""
    numbered AS (SELECT *, row_number() OVER (PARTITION BY county, urban ORDER BY {portable_hash_sql('id', 123)}, id) - 1 AS i,
      count(*) OVER (PARTITION BY county, urban) AS m FROM obs)"""


@query("u06_stratified_folds", "obs", """
    SELECT id, county, urban, CAST(1 + CASE WHEN i < (8 - m % 8) * (m // 8) THEN i // nullif(m // 8, 0)
      ELSE 8 - m % 8 + (i - (8 - m % 8) * (m // 8)) // (m // 8 + 1) END AS BIGINT) AS fold FROM numbered""", ctes=FOLDS)
def _(spark, sf):
    return Sm.stratified_folds(V.obs(spark, sf), ["county", "urban"], "id").select("id", "county", "urban", "fold")


@query("u07_region_folds", "obs", "SELECT region AS fold, count(*) AS n, avg(truth) AS truth FROM obs GROUP BY region", rnd="truth")
def _(spark, sf):
    return Sm.region_folds(V.obs(spark, sf), "region").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("truth").alias("truth"))


@query("u08_equal_parts", "points", "SELECT id, least((rn - 1) // greatest(total // 7, 1), 6) AS subset FROM sampled", ctes=SAMPLE, ints="subset")
def _(spark, sf):
    return Sm.equal_parts(V.points(spark, sf), "id", 7, 11).select("id", "subset")


@query("u09_holdout", "points", "SELECT id, rn <= round(total * 0.1::DOUBLE) AS held_out FROM sampled", ctes=SAMPLE)
def _(spark, sf):
    return Sm.holdout(V.points(spark, sf), "id", 0.1, 11).select("id", "held_out")


PER = f"""
    taken AS (SELECT id FROM obs WHERE quality = 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY {portable_hash_sql('id', 5)}, id) AS rn
      FROM obs WHERE id NOT IN (SELECT id FROM taken))"""


@query("u10_per_stratum", "obs", "SELECT county, id FROM numbered WHERE rn <= 10", ctes=PER)
def _(spark, sf):
    o = V.obs(spark, sf)
    return Sm.per_stratum(o, ["county"], 10, "id", o.where("quality = 2"), 5).select("county", "id")


DISJOINT = f"""
    s1 AS (SELECT id, 'all' AS sample FROM (SELECT id, row_number() OVER (ORDER BY {portable_hash_sql('id', 40)}, id) AS rn FROM points) WHERE rn <= 200),
    s2 AS (SELECT id, 'rural' AS sample FROM (SELECT id, row_number() OVER (ORDER BY {portable_hash_sql('id', 41)}, id) AS rn FROM points
      WHERE NOT urban AND id NOT IN (SELECT id FROM s1)) WHERE rn <= 150),
    s3 AS (SELECT id, 'urban' AS sample FROM (SELECT id, row_number() OVER (ORDER BY {portable_hash_sql('id', 42)}, id) AS rn FROM points
      WHERE urban AND id NOT IN (SELECT id FROM s1) AND id NOT IN (SELECT id FROM s2)) WHERE rn <= 100)"""


@query("u11_disjoint_samples", "points", "SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3", ctes=DISJOINT)
def _(spark, sf):
    rules = {"all": (None, 200), "rural": (~F.col("urban"), 150), "urban": (F.col("urban"), 100)}
    return Sm.disjoint_samples(V.points(spark, sf), rules, "id", 40).select("id", "sample")


@query("u12_draw_subset", "long_draws", f"""
    SELECT vec_id, i - 1 AS draw, v AS value FROM long_draws
    WHERE i - 1 IN (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY {portable_hash_sql('d', 3)}, d) AS rn FROM range(64) t(d)) WHERE rn <= 10)""",
       rnd="value", ints="draw")
def _(spark, sf):
    # The draw numbers of the table are sampled once; every location keeps the same draws.
    long = V.draws(spark, sf).select("vec_id", F.posexplode("draws").alias("draw", "value"))
    return long.join(Sm.hash_sample(long.select("draw").distinct(), "draw", 10, 3), "draw")


@query("u13_task_list", sql="""
    SELECT s_suppkey AS dataset_id, cov, rng, layers FROM supplier,
      (SELECT unnest(['exponential', 'matern', 'mixture']) AS cov), (SELECT unnest(['01', '05', '1', 'mix']) AS rng), (SELECT unnest([3, 4]) AS layers)
    WHERE (cov = 'mixture') = (rng = 'mix')""", ints="layers")
def _(spark, sf):
    axes = {"cov": ["exponential", "matern", "mixture"], "rng": ["01", "05", "1", "mix"], "layers": [3, 4]}
    return Sm.task_grid(axes, V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id")),
                        (F.col("cov") == "mixture") == (F.col("rng") == "mix"))


@query("u14_split_audit", "grid", f"""
    SELECT code, count(*) AS n FROM (SELECT CAST(value IS NOT NULL AND rn > held AS INT) + 2 * CAST(value IS NOT NULL AND rn <= held AS INT)
      + 4 * CAST(value IS NULL AS INT) AS code FROM audited) GROUP BY code""", ints="code", ctes=f"""
    present AS (SELECT iy * 100 + ix AS cell, row_number() OVER (ORDER BY {portable_hash_sql('iy * 100 + ix', 9)}, iy * 100 + ix) AS rn,
      round(count(*) OVER () * 0.1::DOUBLE) AS held FROM grid WHERE value IS NOT NULL),
    audited AS (SELECT g.value, p.rn, p.held FROM grid g LEFT JOIN present p ON p.cell = g.iy * 100 + g.ix)""")
def _(spark, sf):
    g = V.grid(spark, sf).withColumn("cell", F.col("iy") * 100 + F.col("ix"))
    held = Sm.holdout(g.where("value IS NOT NULL"), "cell", 0.1, 9).select("cell", "held_out")
    j = g.join(held, "cell", "left")
    has = F.col("value").isNotNull()
    return Sm.split_audit(j, has & ~F.col("held_out"), has & F.col("held_out"), ~has)
