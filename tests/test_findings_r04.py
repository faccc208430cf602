"""Faults found on larger tables: rows multiplied behind the planner's back, searches that shuffle every pair."""
import numpy as np
from pyspark.sql import functions as F

from spatialscore.llm import topk
from spatialscore.operators import posterior as Po
from spatialscore.operators import rings as Ri
from spatialscore.operators import spatial as Sp
from spatialscore.operators.ordering import portable_hash, with_portable_hashes


def _final_plan(d):
    d.collect()
    return d._jdf.queryExecution().executedPlan().toString()


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """the planner sizes query blocks before they are copied to every group of shards."""
    d = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * m % 31 / 31.0).cast("float") for m in (3, 7, 11)]).alias("embedding"))
    out = topk.top_k(d, d.where("vec_id % 50 = 0"), k=3, shards=40)
    plan = _final_plan(out)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r[0] for r in out.groupBy("query_id").count().select("count").collect()} == {3}


def test_normal_equations_join_points_not_their_entries(spark):
    """entries were joined with the fitted values, and dozens of rows for each point were broadcast."""
    from spatialscore.plans import catalogue
    plan = catalogue.QUERIES["m11_normal_equations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    top = next(i for i, line in enumerate(lines) if "Aggregate" in line and "max(a" in line)
    assert "Generate" in next(line for line in lines[top:] if "Generate" in line or "Join" in line)


def test_entries_keep_carried_columns(spark):
    from spatialscore.operators.lattice import basis_entries, lattice
    p = spark.createDataFrame([(1, 2.0, 3.0, 7.0), (2, 8.0, 1.0, -1.0)], "id long, east double, north double, v double")
    layers = lattice((0.0, 10.0), (0.0, 10.0), nc=4, n_buffer=1, n_layer=2)
    plain = basis_entries(p, layers, "id", "east", "north").join(p.select("id", "v"), "id")
    kept = basis_entries(p, layers, "id", "east", "north", ["v"])
    assert kept.columns == ["id", "layer", "knot", "a", "v"] and kept.count() == plain.count() > 40
    assert kept.exceptAll(plain).isEmpty()


def _brute(pts, refs, k, may):
    want = {}
    for key, (px, py, *rest) in pts.items():
        d = sorted((float(np.sqrt((px - x) * (px - x) + (py - y) * (py - y))), r) for r, (x, y, *of) in refs.items() if may(rest, of, (px, py) == (x, y)))
        if d:
            want[key] = d[:k]
    return want


def test_tiles_find_the_neighbours_that_brute_force_finds(spark, monkeypatch):
    """tiles of 40 references; ties, copies of a place, a dense cluster, points far outside, groups and folds."""
    monkeypatch.setattr(Sp, "TILE", 40)
    rng = np.random.default_rng(3)
    places = [(float(a), float(b)) for a, b in rng.integers(0, 40, (500, 2))] + [(3.0, 3.0)] * 30 + [(5 + float(a), 5 + float(b)) for a, b in rng.random((200, 2)) / 50]
    refs = {i: (x, y, i % 3) for i, (x, y) in enumerate(places)}
    pts = {1000 + i: (x, y, i % 4) for i, (x, y) in enumerate(places[::4] + [(-500.0, 9.0), (20.5, 900.0), (300.25, 300.5)])}
    r = spark.createDataFrame([(i, *v) for i, v in refs.items()], "rid long, east double, north double, g int")
    p = spark.createDataFrame([(i, *v) for i, v in pts.items()] + [(5, None, 1.0, 0)], "id long, east double, north double, g int")

    def got(d):
        out = {}
        for row in d.orderBy("id", "rank").collect():
            out.setdefault(row["id"], []).append((row["d"], row["rid"]))
        return out

    assert got(Sp.nearest(p, r, "id", "rid", k=7)) == _brute(pts, refs, 7, lambda a, b, same: True)
    assert got(Sp.nearest(p, r, "id", "rid", k=7, exclude_zero=True)) == _brute(pts, refs, 7, lambda a, b, same: not same)
    assert got(Sp.nearest(p, r, "id", "rid", k=7, group=["g"])) == _brute(pts, refs, 7, lambda a, b, same: a == b)
    folds = Sp.other_folds([0, 1, 2])
    assert got(Sp.nearest(p.withColumnRenamed("g", "_fold"), r.withColumnRenamed("g", "_of"), "id", "rid", k=7, choice=folds)) == _brute(pts, refs, 7, lambda a, b, same: a != b)
    few = Sp.nearest_lists(p, r.where("rid < 4"), "id", "rid", k=7, own=["g"]).collect()
    assert {row["id"] for row in few} == set(pts) and all(len(row["_d"]) == 4 and row["g"] == pts[row["id"]][2] for row in few)
    assert Sp.nearest(p, r.limit(0), "id", "rid", k=7).count() == 0


def test_search_shuffles_points_not_pairs(spark):
    """only points at the border of their tile go on to others; the search wrote every pair before."""
    p = spark.range(20000).select("id", ((F.col("id") * 7919) % 10007 / 100).alias("east"), ((F.col("id") * 104729) % 10009 / 100).alias("north"))
    met = []
    inner = Sp._in_tiles
    Sp._in_tiles = lambda rows, *a, **b: met.append(rows) or inner(rows, *a, **b)
    try:
        Sp.nearest_lists(p, p, "id", "id", k=15)
    finally:
        Sp._in_tiles = inner
    counts = [m.count() for m in met]
    assert counts[0] == 20000 and counts[1] < 10000 and counts[2] == 20000


def test_subset_draws_stay_in_the_row_of_their_point(spark):
    """quantiles of the atoms of a row equal those of the exploded atoms."""
    rows = [(i, v, t, 0.1 + (i * t % 5)) for i in range(30) for t, v in enumerate([3.0, 1.0, 2.0, 2.0, None, -1.0 * i])]
    long = spark.createDataFrame(rows, "id long, v double, t int, w double")
    wide = long.groupBy("id").agg(F.collect_list(F.struct(F.col("v").alias("value"), F.col("t").alias("tie"), F.col("w").alias("weight"))).alias("a"))
    probs = {"q5": 0.05, "q50": 0.5, "q95": 0.95}
    a = Po.weighted_quantiles_of(wide, ["id"], "a", probs).orderBy("id").collect()
    assert a == Po.weighted_quantiles(long, ["id"], "v", "w", "t", probs).orderBy("id").collect() and len(a) == 30


def test_hashes_of_columns_equal_the_plain_hash(spark):
    d = spark.range(-50, 50).select((F.col("id") * 123456789123).alias("id"))
    out = with_portable_hashes(d.withColumn("p", portable_hash("id", 7)), {"h": F.col("id")}, 7)
    assert out.where("p <> h").isEmpty()


def test_edges_of_areas_are_not_broadcast(spark):
    """a row of rings holds any number of edges, of which the planner knows nothing."""
    corners = F.array(*[F.struct((F.col("id") + a).cast("double").alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0.0), (2, 0.0), (1, 3.0))])
    rings = spark.range(50).select(F.col("id").alias("area"), F.lit(1).alias("ring_id"), corners.alias("vertices"))
    plan = _final_plan(Ri._stretches(rings, Ri._boxes(rings, 100, 10.0)))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
