"""Cases that were lost or mixed up before: seeds, far positions, empty groups and odd lines."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatialscore.functions import transforms as Tr
from spatialscore.operators import compare as Cm
from spatialscore.operators import kriging as Kr
from spatialscore.operators import posterior as Po
from spatialscore.operators import strata as St
from spatialscore.operators.lattice import basis_entries, lattice, sparse_apply
from spatialscore.operators.ordering import HASH_RANGE, portable_hash, portable_hash_sql
from spatialscore.operators.spatial import preceding_neighbours
from spatialscore.sources.tables import read_whitespace
from spatialscore.streaming.scores import ingest_stream, running_binned_scores


def ids(spark, n, seed, step=1):
    d = spark.range(n).select((F.col("id") * step).alias("id")).withColumn("h", portable_hash("id", seed))
    return {r["id"] for r in d.orderBy("h", "id").limit(1000).collect()}


def test_seeds_give_independent_orders(spark):
    n = 100_000
    shared = len(ids(spark, n, 7) & ids(spark, n, 123))
    assert abs(shared - 1000 * 1000 / n) < 15


def test_far_ids_do_not_cluster(spark):
    d = spark.range(200_000).select((F.col("id") * 1_000_003).alias("id")).withColumn("h", portable_hash("id", 1))
    assert d.select("h").distinct().count() > 199_980
    cells = d.groupBy(F.floor(F.col("h") * 100 / HASH_RANGE)).count().toPandas()["count"]
    assert len(cells) == 100 and cells.min() > 1700 and cells.max() < 2300


def test_hash_of_any_sign_agrees_with_sql(spark, con):
    v = [0, 1, -1, 12345678901234, -12345678901234, 2**63 - 1, -(2**63)]
    got = [r["h"] for r in spark.createDataFrame([(x,) for x in v], "x long").select(portable_hash("x", 11).alias("h")).collect()]
    want = [con.execute(f"SELECT {portable_hash_sql('x', 11)} FROM (SELECT CAST(? AS BIGINT) AS x)", [x]).fetchone()[0] for x in v]
    assert got == want and all(0 <= h < HASH_RANGE for h in got)


def test_subset_draws_all_count(spark):
    """With one training value everywhere the pooled draws are normal around it with the subsets' sd."""
    rng = np.random.default_rng(1)
    train = pd.DataFrame({"rid": range(400), "east": rng.uniform(0, 20, 400), "north": rng.uniform(0, 20, 400), "truth": 5.0})
    test = pd.DataFrame({"pid": range(60), "east": rng.uniform(0, 20, 60), "north": rng.uniform(0, 20, 60)})
    params = {"range": 2.0, "sill": 1.0, "nugget": 0.5, "mean": 5.0}
    args = (spark.createDataFrame(train), spark.createDataFrame(test), "pid", "rid", 3, params)
    q = Kr.subset_combine(*args, n_draws=200, seed=3).toPandas()
    assert len(q) == 60
    assert abs(q["q50"].mean() - 5.0) < 0.1
    half = (q["q_upper"] - q["q_lower"]).mean() / 2 / 1.96
    assert 0.6 < half < 1.3 and (q["q_lower"] < q["q50"]).all()


def test_targets_without_data_get_the_prior(spark):
    train = spark.createDataFrame([("a", 0.0, 0.0, 1.0)], "k string, x double, y double, z double")
    test = spark.createDataFrame([("a", 1, 0.0, 1.0), ("b", 2, 0.0, 0.0)], "k string, id long, x double, y double")
    got = {r["id"]: r for r in Kr.krige_groups(train, test, ["k"], "id", Kr.exponential(1.0, 4.0), 0.0, 3.0).collect()}
    assert set(got) == {1, 2} and got[2]["preds"] == 3.0 and got[2]["sigmas"] == 2.0


def test_area_without_weight_is_null(spark):
    d = spark.createDataFrame([(1, 0.0, [1.0, 2.0]), (2, 1.0, [3.0, 4.0]), (2, 1.0, None)], "area int, w double, draws array<double>")
    got = {r["area"]: r["draws"] for r in Po.areal_draws(d, ["area"], "w", "draws").collect()}
    assert got == {1: None, 2: [3.0, 4.0]}


def test_point_outside_the_lattice_is_zero(spark):
    layers = lattice((0.0, 10.0), (0.0, 10.0), 4, 1)
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 500.0, 500.0)], "id long, x double, y double")
    coef = spark.createDataFrame([(1, k, 1.0) for k in range(400)], "layer int, knot long, c double")
    got = {r["id"]: r["value"] for r in sparse_apply(basis_entries(pts, layers, "id", "x", "y"), coef, "id", points=pts).collect()}
    assert got[2] == 0.0 and got[1] > 0


def test_positions_beyond_two_to_41(spark):
    base = 2**42
    d = spark.createDataFrame([(p, float(i), 0.0) for i, p in enumerate([0, 5, base, base + 7])], "pos long, x double, y double")
    got = {(r["pos"], r["rid"]) for r in preceding_neighbours(d, "pos", "x", "y", 2).collect()}
    assert got == {(5, 0), (base, 0), (base, 5), (base + 7, base), (base + 7, 5)}


def test_line_with_missing_field_stops(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a  b\n1 2\n\n3\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        read_whitespace(spark, str(tmp_path), "a int, b int").collect()


def test_equal_losses_are_ties(spark):
    d = spark.createDataFrame([("b", 1.0), ("a", 1.0 + 1e-13)], "method string, crps double")
    got = {r["method"]: r["rank_crps"] for r in Cm.rank_methods(d, "method", ["crps"]).collect()}
    assert got == {"a": 1, "b": 2}


SCORES = "err double, abs_err double, sq_err double, crps double, interval_score double, coverage double, width double"


def scored(spark, rows, extra):
    return spark.createDataFrame([(*r, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0) for r in rows], f"{extra}, {SCORES}")


def test_null_stratum_is_not_rural(spark):
    d = scored(spark, [("m", True), ("m", False), ("m", None)], "model string, urban boolean")
    got = sorted((r["subset"] or "", r["n"]) for r in St.scores_by_subset(d, ["model"]).collect())
    assert got == [("", 1), ("Avg", 3), ("Rural", 1), ("Urban", 1)]


def test_null_distance_is_not_the_pooled_row(spark):
    d = scored(spark, [("m", 1.0), ("m", 2.0), ("m", None)], "model string, dist double")
    rows = St.scores_by_even_distance(d, "dist", 3, ["model"]).where("bin IS NULL").collect()
    assert sorted((r["pooled"], r["n_per_bin"]) for r in rows) == [(False, 1), (True, 3)]


def test_matern_of_any_smoothness(spark):
    """The integral against the closed forms and a known value: K_1(1) = 0.6019072301972346."""
    d = spark.createDataFrame([(0.0,), (1e-6,), (0.3,), (1.0,), (4.0,), (30.0,), (None,)], "d double")
    for nu in (0.5, 1.5, 2.5):
        rows = d.select(Tr.correlation("d", "matern", 2.0, nu).alias("a"), Tr.integrated_matern(F.col("d") / 2.0, nu).alias("b")).collect()
        assert all((r["a"] is None and r["b"] is None) or abs(r["a"] - r["b"]) < 1e-9 for r in rows)
    one = spark.range(1).select(Tr.correlation(F.lit(1.0 / np.sqrt(2.0)), "matern", 1.0, 1.0).alias("c")).first()["c"]
    assert abs(one - 0.6019072301972346) < 1e-9
    with pytest.raises(ValueError):
        Tr.correlation("d", "spherical", 1.0)


def test_many_nuggets_are_one_expression(spark):
    v = [0.01 * i for i in range(1000)]
    got = spark.createDataFrame([(2.0,), (None,)], "sd double").select(Tr.add_nugget_sd("sd", v).alias("s")).collect()
    assert got[0]["s"] == pytest.approx(np.sqrt(4 + np.array(v)).mean()) and got[1]["s"] is None


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark of an earlier batch no longer counts; one within it does."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "ts timestamp, model string, crps double"
    batches = [[("2024-01-01 12:00:00", 1.0), ("2024-01-20 00:00:00", 1.0)], [("2024-01-02 00:00:00", 9.0), ("2024-01-19 06:00:00", 3.0)],
               [("2024-02-20 00:00:00", 1.0)]]
    for rows in batches:
        pdf = pd.DataFrame([(pd.Timestamp(t), "m", c) for t, c in rows], columns=["ts", "model", "crps"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(src)
        agg = running_binned_scores(ingest_stream(spark, src, schema, []), "ts", "2 days", "1 day", ["model"], ["crps"])
        q = (agg.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(out))
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {(str(r["day"])[:10], r["n"], r["crps"]) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-19", 1, 3.0) in got and ("2024-01-01", 1, 1.0) in got
    assert not any(day == "2024-01-02" for day, _, _ in got)


def test_basis_queries_keep_a_point_outside_the_lattice(spark, monkeypatch):
    from __spark_entry__ import queries
    from spatialscore.plans import views

    pts = views.points(spark, "/root/testdata/sf0.001").cache()
    far = pts.where("role = 'test'").limit(1).withColumns({"id": F.lit(-1).cast(pts.schema["id"].dataType), "east": F.lit(9e3), "north": F.lit(9e3)})
    both = pts.unionByName(far).cache()
    monkeypatch.setattr(views, "points", lambda *a: both)
    got = queries()["m11_basis_regression"](spark, "/root/testdata/sf0.001").where("id = -1").collect()
    assert [r["pred"] for r in got] == [250.0]
    got = queries()["d31_layer_contributions"](spark, "/root/testdata/sf0.001").where("id = -1").collect()
    assert len(got) >= 1 and {r["value"] for r in got} == {0.0}
