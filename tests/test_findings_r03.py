"""Faults found on larger tables: stalled rounds, points met by every area, rows carried through searches."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spatialscore.operators import ordering as Or
from spatialscore.operators import spatial as Sp
from spatialscore.operators.rings import areas_at_points
from spatialscore.operators.sparse import conjugate_gradients
from spatialscore.session import bounded_tasks


def test_solver_ends_on_an_ill_conditioned_block(spark):
    n = 12
    a = 1.0 / (np.arange(n)[:, None] + np.arange(n)[None, :] + 1.0)
    b = np.cos(1.7 * np.arange(n))
    m = spark.createDataFrame(pd.DataFrame([(i, j, a[i, j]) for i in range(n) for j in range(n)], columns=["i", "j", "v"]))
    rhs = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "b": b}))
    # The first solve of the block leaves a residual of rounding size, which further rounds must lower.
    got = conjugate_gradients(m, rhs, 1e-6, most_rounds=15).toPandas().sort_values("i")["x"].to_numpy()
    assert np.linalg.norm((a + 1e-6 * np.eye(n)) @ got - b) < 1e-9 * np.linalg.norm(b)


def _crossing(px, py, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > py) != (by > py) and px < ax + (py - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def test_counts_of_overlapping_areas_equal_the_plain_test(spark):
    """Nested, jagged, negative, holed and degenerate areas; a point gets a row a side and list, not one for each area."""
    rng = np.random.default_rng(5)
    turn = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    made = {(a, 1): [(-4.0 - a / 100, -4.0), (float(a), -4.0), (float(a), a / 2), (0.5, a / 3), (-3.0, a / 2)] for a in range(2, 60)}
    made |= {(100, 1): [(float(10 + r * np.cos(t)), float(10 + r * np.sin(t))) for t, r in zip(turn, 20 + 10 * rng.random(3000))],
             (100, 2): [(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0)], (100, 3): [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0)],
             (101, 1): [(1.0, 1.0), (2.0, 2.0)], (102, 1): [(float(a), float(b)) for a, b in rng.random((60, 2)) * 50 - 10], (103, 1): [(7.0, 7.0)] * 4}
    rings = spark.createDataFrame([(a, r, [{"x": x, "y": y} for x, y in v]) for (a, r), v in made.items()], "area int, ring_id int, vertices array<struct<x:double,y:double>>")
    pts = [tuple(map(float, p)) for p in rng.random((500, 2)) * 60 - 15] + [(float(a), float(b)) for a in range(-4, 20, 3) for b in range(-4, 20, 2)] + made[100, 1][::100]
    d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)] + [(-1, None, 1.0)], "id int, east double, north double")
    got = {r["id"]: (r["area"], r["n_areas"]) for r in areas_at_points(d, rings, "id", "east", "north").collect()}
    want = {}
    for i, (x, y) in enumerate(pts):
        odd = {}
        for (a, _), v in made.items():
            odd[a] = odd.get(a, False) ^ (len(v) > 2 and _crossing(x, y, v))
        held = [a for a, o in odd.items() if o]
        if held:
            want[i] = (min(held), len(held))
    assert got == want


def test_search_gives_out_no_members_beyond_the_bound(spark):
    p = spark.range(4000).select(F.col("id").alias("rid"), ((F.col("id") * 7919) % 10007 / 100).alias("x"), ((F.col("id") * 104729) % 10009 / 100).alias("y"))
    pyr = Sp.build_pyramid(p, [], "x", "y", 15)
    q = p.select(F.col("rid").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    assert Sp._search(q, pyr, [], 15).count() < 40 * 4000


def test_selection_stores_values_before_it_drops_nulls(spark, monkeypatch):
    """a filter in front of the stored values would hold the whole expression of the value a second time."""
    seen, written = [], Or.written
    monkeypatch.setattr(Or, "written", lambda d: seen.append(d) or written(d))
    d = spark.range(3000).withColumn("x", F.when(F.col("id") % 10 != 0, (F.col("id") * 7919 % 1009).cast("double")))
    d = d.withColumn("x", F.col("x") * F.col("x") - F.col("x")).withColumn("x", F.col("x") / (F.col("x") * F.col("x") + 1.0)).withColumn("k", F.col("id") % 3)
    rows = d.toPandas()
    got = Or.group_quantiles(d, ["k"], "x", "id", {"q0": 0.0, "q30": 0.3, "q100": 1.0}).toPandas().set_index("k")
    assert "Filter" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    for k, g in rows.dropna().groupby("k"):
        assert got.loc[k, "n"] == len(g)
        np.testing.assert_allclose(got.loc[k, ["q0", "q30", "q100"]].astype(float), np.quantile(g["x"], [0, 0.3, 1]), rtol=1e-12)


def test_search_brings_no_point_to_the_root_by_shuffle(spark):
    """all points met the root cell in one task, and tasks were as many whatever the table."""
    p = spark.range(4000).select(F.col("id").alias("rid"), ((F.col("id") * 7919) % 10007 / 100).alias("x"), ((F.col("id") * 104729) % 10009 / 100).alias("y"))
    cells = Sp.build_pyramid(p, [], "x", "y", 8).cells
    zero = F.col("rid") % 1
    rows = p.select("rid", zero.cast("int").alias("lvl"), zero.alias("cx"), zero.alias("cy"))
    plan = Sp._at_cells(rows, cells)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and Sp._at_cells(rows, cells).count() == 4000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with bounded_tasks(spark, 5_000_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
