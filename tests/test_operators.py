"""Group operators, strata, areas and sampling: rules, edges and skewed groups."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatialscore.operators import areal as Ar
from spatialscore.operators import compare as Cm
from spatialscore.operators import posterior as Po
from spatialscore.operators import sampling as Sm
from spatialscore.operators import strata as St
from spatialscore.operators.lattice import basis_entries, lattice, sparse_apply
from spatialscore.operators.ordering import group_quantiles, next_value, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with nine tenths of the rows, one value with a third of them."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.9, "hot", "cold"),
                        "v": np.where(rng.random(n) < 0.33, 5.0, rng.normal(5, 3, n).round(1)), "w": rng.integers(1, 5, n).astype(float)})
    return spark.createDataFrame(pdf), pdf


def test_ordered_equals_plain_windows(skewed):
    df, pdf = skewed
    got = ordered(df, ["g"], "v", "id", {"cum": "w"}).toPandas().sort_values(["g", "v", "id"])
    assert (got["rn"].to_numpy() == got.groupby("g").cumcount().to_numpy() + 1).all()
    assert (got["rank"] == got.groupby("g")["v"].rank(method="min")).all()
    assert np.allclose(got["cum"], got.groupby("g")["w"].cumsum())
    assert (got["group_n"] == got.groupby("g")["id"].transform("size")).all()


def test_group_quantiles_exact(skewed):
    df, pdf = skewed
    got = group_quantiles(df, ["g"], "v", "id", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0, 0.1, 0.5, 1.0]).unstack().sort_index()
    assert np.allclose(got[["a", "b", "c", "d"]].to_numpy(), want.to_numpy())


def test_next_value(spark):
    r = next_value(spark.createDataFrame([(3.0,), (1.0,), (1.0,), (7.0,)], "x double"), "x").orderBy("x").collect()
    assert [(a["x"], a["next"]) for a in r] == [(1.0, 3.0), (3.0, 7.0), (7.0, None)]


def single(spark, rows):
    cols = "id long, dist double, err double, sq_err double, crps double, interval_score double, coverage double, width double"
    return spark.createDataFrame([(i, d, 1.0, 1.0, c, 1.0, 1.0, 1.0) for i, d, c in rows], cols)


def test_equal_count_seams(spark):
    b = St.equal_count_distance(single(spark, [(i, float(i), 0.0) for i in range(1, 8)]), "dist", "id", n_per_bin=3)
    got = b.groupBy("bin", "bin_low", "bin_high").count().orderBy("bin").collect()
    assert [(r["bin_low"], r["bin_high"], r["count"]) for r in got] == [(0.0, 3.5, 3), (3.5, 6.5, 3), (6.5, pytest.approx(7.000001), 1)]


def test_equal_count_more_than_rows_gives_one_bin(spark):
    b = St.equal_count_distance(single(spark, [(i, float(i), 0.0) for i in range(1, 5)]), "dist", "id", n_per_bin=10)
    assert b.select("bin").distinct().count() == 1


def test_distance_cutoff_is_strict(spark):
    b = St.scores_by_distance(single(spark, [(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 3.0, 0.0)]), "dist", "id", breaks=[0.0, 1.5, 3.0])
    assert {r["bin"]: r["n_per_bin"] for r in b.collect()} == {1: 1, 2: 1}


def test_merge_binned_weights_and_lone_bins(spark):
    a = spark.createDataFrame([(1, 1, 4.0), (2, 5, 9.0)], "bin int, n long, s double")
    b = spark.createDataFrame([(1, 3, 0.0)], "bin int, n long, s double")
    got = {r["bin"]: (r["n"], r["s"]) for r in St.merge_binned([a, None, b], "bin", "n", ["s"]).collect()}
    assert got == {1: (4, 1.0), 2: (5, 9.0)}


def test_empty_stratum_is_null(spark):
    rows = [("N", True, 1.0), ("N", True, 3.0)]
    df = spark.createDataFrame(rows, "region string, urban boolean, err double").withColumns(
        {"sq_err": F.col("err"), "crps": F.col("err"), "interval_score": F.col("err"), "coverage": F.col("err"), "width": F.col("err")})
    got = {r["subset"]: (r["n"], r["crps"]) for r in St.complete_subsets(St.scores_by_subset(df, ["region"]), ["region"]).collect()}
    assert got == {"Avg": (2, 2.0), "Urban": (2, 2.0), "Rural": (0, None)}


def test_best_and_worst_with_ties_and_null(spark):
    df = spark.createDataFrame([("a", 70.0), ("b", 82.0), ("c", 90.0), ("d", None)], "m string, coverage double")
    r = {x["m"]: (x["coverage_best"], x["coverage_worst"]) for x in Cm.flag_best_worst(df, ["coverage"], {"coverage": 80}).collect()}
    assert r == {"a": (False, True), "b": (True, False), "c": (False, True), "d": (False, False)}


def test_urban_threshold_by_hand(spark):
    p = spark.createDataFrame([("x", i, float(i), 0.4) for i in (1, 2, 3, 4)], "county string, pixel long, pop double, pct double")
    t = Ar.urban_threshold(p, "county", "pop", "pixel", "pct")
    assert t.first()["threshold"] == 3.0
    assert [r["pixel"] for r in Ar.urban_flag(p, t, "county", "pop").where("urban").collect()] == [4]
    assert Ar.urban_threshold(p, "county", "pop", "pixel", "pct", ("x",)).first()["threshold"] == float("-inf")


def test_weighted_quantiles_by_hand(spark):
    d = spark.createDataFrame([("k", 1.0, 0.2, 1), ("k", 2.0, 0.3, 2), ("k", 3.0, 0.5, 3)], "k string, v double, w double, i int")
    assert Po.weighted_quantiles(d, ["k"], "v", "w", "i", {"q": 0.5}).first()["q"] == 2.0


def test_rescaled_population_meets_targets(spark):
    p = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("a", False, 0.0)], "county string, urban boolean, pop double")
    t = spark.createDataFrame([("a", True, 100.0), ("a", False, 50.0)], "county string, urban boolean, target double")
    got = Ar.rescale_population(p, t, ["county", "urban"], "pop").groupBy("urban").agg(F.sum("pop_adjusted").alias("s"))
    assert {r["urban"]: r["s"] for r in got.collect()} == {True: 100.0, False: 0.0}


def test_areal_draws_with_equal_weights_equal_block_means(spark):
    d = spark.createDataFrame([(i, i % 3, 1.0, [float(i), float(i * i)]) for i in range(30)], "id long, area int, w double, draws array<double>")
    got = {r["area"]: list(r["draws"]) for r in Po.areal_draws(d, ["area"], "w", "draws").collect()}
    want = d.groupBy("area").agg(F.avg(F.col("draws")[0]).alias("a"), F.avg(F.col("draws")[1]).alias("b")).collect()
    for r in want:
        assert got[r["area"]] == pytest.approx([r["a"], r["b"]])


def test_fold_sizes(spark):
    df = spark.range(11).withColumn("s", F.lit("x"))
    sizes = [r["count"] for r in Sm.stratified_folds(df, ["s"], "id", 8).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [1, 1, 1, 1, 1, 2, 2, 2]


def test_folds_of_a_small_stratum(spark):
    df = spark.range(3).withColumn("s", F.lit("x"))
    folds = sorted(r["fold"] for r in Sm.stratified_folds(df, ["s"], "id", 8).collect())
    assert folds == [6, 7, 8]


def test_split_counts_of_the_test_grid(spark):
    # 100 x 100 cells, 29 % missing, a rounded tenth of the rest held out.
    g = spark.range(10000).withColumn("missing", F.col("id") % 100 < 29)
    held = Sm.holdout(g.where("NOT missing"), "id", 0.1, 122)
    j = g.join(held.select("id", "held_out"), "id", "left")
    h = F.coalesce("held_out", F.lit(False))
    got = Sm.split_audit(j, ~F.col("missing") & ~h, ~F.col("missing") & h, F.col("missing"))
    assert {r["code"]: r["n"] for r in got.collect()} == {1: 6390, 2: 710, 4: 2900}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = {r["id"] for r in Sm.hash_sample(df.repartition(1), "id", 50, 3).collect()}
    b = {r["id"] for r in Sm.hash_sample(df.repartition(13), "id", 50, 3).collect()}
    assert a == b and len(a) == 50


def test_adjusted_rand_of_equal_labelings(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("a"), (F.col("id") % 4 + 10).alias("b"))
    assert St.adjusted_rand(df, "a", "b").first()["adjusted_rand"] == pytest.approx(1.0)


def test_basis_matches_brute_force(spark):
    layers = lattice((0.0, 10.0), (0.0, 7.0), nc=5, n_buffer=2, n_layer=2)
    assert (layers[0].nx, layers[0].ny) == (9, 7) and layers[1].width == pytest.approx(1.25)
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"id": range(40), "x": rng.random(40) * 10, "y": rng.random(40) * 7})
    e = basis_entries(spark.createDataFrame(pts), layers, "id", "x", "y").toPandas()
    for l in layers:
        kx, ky = np.meshgrid(np.arange(l.nx), np.arange(l.ny), indexing="ij")
        k = np.column_stack([l.x0 + kx.ravel() * l.width, l.y0 + ky.ravel() * l.width])
        s = np.sqrt(((pts[["x", "y"]].to_numpy()[:, None] - k[None]) ** 2).sum(-1)) / l.theta
        want = np.where(s < 1, (1 - s) ** 6 * (35 * s**2 + 18 * s + 3) / 3, 0)
        got = np.zeros_like(want)
        part = e[e["layer"] == l.layer]
        got[part["id"], part["knot"]] = part["a"]
        assert np.allclose(got, want)
    coef = spark.createDataFrame([(1, int(k), 1.0) for k in range(layers[0].nx * layers[0].ny)], "layer int, knot long, c double")
    s1 = sparse_apply(basis_entries(spark.createDataFrame(pts), layers, "id", "x", "y"), coef, "id").toPandas().set_index("id")["value"]
    assert np.allclose(s1.sort_index(), e[e["layer"] == 1].groupby("id")["a"].sum().sort_index())


def test_noise_is_repeatable_and_centred(spark):
    d = spark.createDataFrame([(i, [0.3] * 400, 20) for i in range(20)], "id long, draws array<double>, n int")
    def mean(part):
        r = Po.add_noise(d.repartition(part), "id", "draws", "binomial", size="n", seed=4).orderBy("id").collect()
        return np.array([x["noisy"] for x in r])
    a, b = mean(1), mean(7)
    assert (a == b).all() and abs(a.mean() - 0.3) < 0.005
    assert a.var() == pytest.approx(0.3 * 0.7 / 20, rel=0.1)
    g = np.array([x["noisy"] for x in Po.add_noise(d.withColumn("v", F.lit(0.25)), "id", "draws", "gaussian", var="v").collect()])
    assert g.std() == pytest.approx(0.5, rel=0.05)
    be = np.array([x["noisy"] for x in Po.add_noise(d, "id", "draws", "beta", rho=0.1).collect()])
    assert be.mean() == pytest.approx(0.3, abs=0.01) and be.var() == pytest.approx(0.3 * 0.7 * 0.1, rel=0.1)
    with pytest.raises(ValueError):
        Po.add_noise(d, "id", "draws", "binomial")


def test_convex_hull(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.random((500, 2)), [[-1, -1], [2, -1], [2, 2], [-1, 2]]])
    h = Ar.convex_hull(spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"])).repartition(6), "x", "y").orderBy("vertex").collect()
    assert [(r["x"], r["y"]) for r in h] == [(-1, -1), (2, -1), (2, 2), (-1, 2)]


def test_convex_hull_of_hull_points_only(spark):
    """Every point is a vertex, so chords are split until tasks are small; odd inputs have their hull too."""
    t = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    ring = np.round(np.column_stack([np.cos(t), np.sin(t)]), 12)
    inner = np.random.default_rng(1).random((2000, 2)) - 0.5
    df = lambda rows: spark.createDataFrame([(float(a), float(b)) for a, b in rows], "x double, y double")
    h = Ar.convex_hull(df(np.vstack([ring, inner, ring[:50]])).repartition(5), "x", "y", sector_points=100).orderBy("vertex").toPandas()
    assert h["vertex"].tolist() == list(range(1, 3001))
    start = int(np.lexsort((ring[:, 1], ring[:, 0]))[0])
    assert np.array_equal(h[["x", "y"]].to_numpy(), np.roll(ring, -start, axis=0))
    got = lambda rows: [(r["x"], r["y"]) for r in Ar.convex_hull(df(rows), "x", "y").orderBy("vertex").collect()]
    assert got([(1, 2)] * 3) == [(1, 2)]
    assert got([(1, i) for i in range(5)]) == [(1, 0), (1, 4)]
    assert got([(0, 0), (1, 1), (2, 2), (float("nan"), 5), (float("inf"), 5)]) == [(0, 0), (2, 2)]
    assert got([(0, 0), (1, 0), (2, 0), (1, 1)]) == [(0, 0), (2, 0), (1, 1)]
    assert got([]) == []


def test_polygon_metrics_of_a_long_ring(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.random(10_000)) * 2 * np.pi
    rings = [np.column_stack([3 * np.cos(t), np.sin(t)]), rng.random((300, 2)), np.array([[0, 0], [4, 0], [4, 3], [0, 3]]),
             np.array([[0, 0], [2, 1]]), np.array([[1, 1]]), np.array([[0, 0], [5, 0], [0, 1]])]
    rows = [("a", i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "area string, ring_id long, vertices array<struct<x: double, y: double>>")
    got = {r["ring_id"]: r for r in Ar.polygon_metrics(df).collect()}
    for i, r in enumerate(rings):
        far = max(np.hypot(*(r - p).T).max() for p in r) / 2
        assert got[i]["radius"] == pytest.approx(far, abs=1e-12)
        area = abs(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) / 2
        assert got[i]["ring_area"] == pytest.approx(area, abs=1e-9)
    assert [i for i, r in got.items() if r["largest"]] == [2]


def test_levels_add_up_from_the_finest(spark):
    rows = [("p1", "c1", "r1", 2.0, [1.0, 2.0]), ("p2", "c1", "r1", 1.0, [4.0, 5.0]), ("p3", "c2", "r1", 1.0, [0.0, 3.0]),
            ("p4", "c3", "r2", 0.0, [9.0, 9.0]), ("p5", "c2", "r1", 5.0, None)]
    df = spark.createDataFrame(rows, "pixel string, county string, region string, w double, draws array<double>")
    out = Po.aggregate_levels(df, {"county": ["county"], "region": ["region"]}, "w", "draws")
    got = {(r["level"], r["area"]): r["est"] for r in out.collect()}
    assert got == {("county", "c1"): pytest.approx(2.5), ("county", "c2"): pytest.approx(1.5), ("county", "c3"): None,
                   ("region", "r1"): pytest.approx(2.25), ("region", "r2"): None}
