"""Kriging, trends, sources and streams."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatialscore.operators import kriging as Kr
from spatialscore.operators import trend as Tr
from spatialscore.operators.sparse import conjugate_gradients
from spatialscore.operators.lattice import lattice
from spatialscore.plans import views as V
from spatialscore.sources import tables as Tb
from spatialscore.streaming.scores import ingest_stream, running_binned_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(8)
    n = 240
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.arange(n) % 3, "x": rng.random(n) * 10, "y": rng.random(n) * 10})
    pdf["z"] = np.sin(pdf["x"]) + 0.5 * pdf["y"] + rng.normal(0, 0.1, n)
    return spark.createDataFrame(pdf), pdf


def test_kriging_returns_the_observation_without_nugget(field):
    df, pdf = field
    r = Kr.krige_groups(df, df, ["g"], "id", Kr.exponential(2.0)).toPandas().sort_values("id")
    assert np.allclose(r["preds"], pdf["z"], atol=1e-6) and np.allclose(r["sigmas"], 0, atol=1e-6)


def test_group_kriging_equals_numpy_and_survives_chunks(field, monkeypatch):
    df, pdf = field
    monkeypatch.setattr(Kr, "MAX_CHUNK", 7)
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    r = Kr.krige_groups(train, test, ["g"], "id", Kr.exponential(2.0), nugget=0.1, beta=1.0).toPandas().set_index("id")
    assert len(r) == 48
    tr, te = pdf[(pdf.id % 5 != 0) & (pdf.g == 1)], pdf[(pdf.id % 5 == 0) & (pdf.g == 1)]
    s = np.exp(-Kr._dist(tr[["x", "y"]].to_numpy(), tr[["x", "y"]].to_numpy()) / 2) + 0.1 * np.eye(len(tr))
    c = np.exp(-Kr._dist(te[["x", "y"]].to_numpy(), tr[["x", "y"]].to_numpy()) / 2)
    assert np.allclose(r.loc[te["id"], "preds"], 1 + c @ np.linalg.solve(s, tr["z"] - 1))


def test_oversize_group_is_refused(field):
    with pytest.raises(ValueError, match="bounded_blocks"):
        Kr.check_group_sizes(field[0], ["g"], 10)


def test_block_likelihood_equals_numpy(field):
    df, pdf = field
    got = Kr.block_gp_grid(df.withColumn("block", F.col("g").cast("string")), "block", "x", "y", "z", ["x"], [0.0, 0.6], [0.5]).toPandas()
    for _, row in got.iterrows():
        xtx, xty, yty, logdet = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0
        for _, b in pdf.groupby("g"):
            d = Kr._dist(b[["x", "y"]].to_numpy(), b[["x", "y"]].to_numpy())
            ri = np.linalg.inv(row["omega"] * np.exp(-row["alpha"] * d) + (1 - row["omega"]) * np.eye(len(b)))
            m = np.column_stack([np.ones(len(b)), b["x"]])
            xtx += m.T @ ri @ m
            xty += m.T @ ri @ b["z"].to_numpy()
            yty += b["z"] @ ri @ b["z"]
            logdet -= np.linalg.slogdet(ri)[1]
        beta = np.linalg.solve(xtx, xty)
        ss = yty - beta @ xty
        s2 = ss / (len(pdf) - 2)
        assert np.allclose(row["beta"], beta) and row["sigma2"] == pytest.approx(s2)
        assert row["loglik"] == pytest.approx(-(len(pdf) / 2) * np.log(s2) - 0.5 * logdet - 0.5 * ss / s2)


def test_local_kriging_with_all_neighbours_is_exact(field):
    df, pdf = field
    train, test = df.where("id % 20 = 1"), df.where("id % 20 = 3")
    p = {"range": 2.0, "sill": 1.0, "nugget": 0.2, "mean": 0.5}
    r = Kr.local_krige(train, test, "id", "id", p, x="x", y="y", z="z", k=12).toPandas().sort_values("id")
    tr, te = pdf[pdf.id % 20 == 1], pdf[pdf.id % 20 == 3].sort_values("id")
    s = np.exp(-Kr._dist(tr[["x", "y"]].to_numpy(), tr[["x", "y"]].to_numpy()) / 2) + 0.2 * np.eye(len(tr))
    c = np.exp(-Kr._dist(te[["x", "y"]].to_numpy(), tr[["x", "y"]].to_numpy()) / 2)
    assert np.allclose(r["pred"], 0.5 + c @ np.linalg.solve(s, tr["z"] - 0.5))
    assert np.allclose(r["sd"], np.sqrt(1.2 - np.einsum("ij,ji->i", c, np.linalg.solve(s, c.T))))


def test_ols_equals_numpy(field):
    df, pdf = field
    t = Tr.ols(df, "z", Tr.product_terms(["x", "y"]))
    m = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["y"], pdf["x"] * pdf["y"]])
    b, *_ = np.linalg.lstsq(m, pdf["z"], rcond=None)
    assert np.allclose([t.intercept, t.slopes["x"], t.slopes["y"], t.slopes["x:y"]], b)
    assert t.r2 == pytest.approx(1 - ((pdf["z"] - m @ b) ** 2).sum() / ((pdf["z"] - pdf["z"].mean()) ** 2).sum())


def test_ridge_equals_numpy(field, spark):
    df, pdf = field
    layers = lattice((0.0, 10.0), (0.0, 10.0), nc=4, n_buffer=1, n_layer=1)
    got = Tr.basis_ridge(df, layers, 0.5, "x", "y", "z").toPandas()
    assert set(got["layer"]) == {1}
    c = np.zeros(layers[0].nx * layers[0].ny)
    c[got["knot"]] = got["c"]
    l = layers[0]
    k = np.array([[l.x0 + i * l.width, l.y0 + j * l.width] for i in range(l.nx) for j in range(l.ny)])
    s = np.sqrt(((pdf[["x", "y"]].to_numpy()[:, None] - k[None]) ** 2).sum(-1)) / l.theta
    a = np.where(s < 1, (1 - s) ** 6 * (35 * s**2 + 18 * s + 3) / 3, 0)
    assert np.allclose(c, np.linalg.solve(a.T @ a + 0.5 * np.eye(len(k)), a.T @ pdf["z"]))


def test_ridge_in_one_block_and_in_many(field, spark):
    """Two layers that partly say the same, cut to squares of a few knots; a chunk of points that meets too many is halved."""
    df, pdf = field
    layers = lattice((0.0, 10.0), (0.0, 10.0), nc=5, n_buffer=1, n_layer=2)
    one = Tr.basis_ridge(df, layers, 0.5, "x", "y", "z").toPandas().set_index(["layer", "knot"])["c"]
    many = Tr.basis_ridge(df, layers, 0.5, "x", "y", "z", tolerance=1e-9, block_knots=120).toPandas().set_index(["layer", "knot"])["c"]
    assert len(one) == len(many) and np.allclose(one.sort_index(), many.sort_index(), atol=1e-6 * one.abs().max())
    got = list(Tr._gram(np.tile(np.arange(3000), 2), np.repeat([0, 1], 3000), np.ones(6000), np.array([1.0, 5.0])))
    total = {}
    for i, j, v in got:
        for k in zip(i.tolist(), j.tolist(), v.tolist()):
            if k[0] == 7 and k[1] in (-1, 7, 9):
                total[k[1]] = total.get(k[1], 0) + k[2]
    assert total == {-1: 6.0, 7: 2.0, 9: 2.0}


def test_solver_of_many_unknowns(spark):
    """A chain of 20,000 unknowns, more than a dense solve takes; its solution is known."""
    n = 20_000
    m = spark.range(n).select("id", F.explode(F.array(F.col("id") - 1, "id", F.col("id") + 1)).alias("j")).where(f"j >= 0 AND j < {n}")
    m = m.select(F.col("id").alias("i"), "j", F.when(F.col("id") == F.col("j"), 2.0).otherwise(-1.0).alias("v"))
    want = F.sin(F.col("i") / 50.0)
    x = spark.range(n).select(F.col("id").alias("i"), F.sin(F.col("id") / 50.0).alias("x"))
    rhs = m.join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("b"))
    rhs = rhs.join(x, "i").select("i", (F.col("b") + 0.5 * F.col("x")).alias("b"))
    got = conjugate_gradients(m, rhs, 0.5)
    off = got.select(F.max(F.abs(F.col("x") - want)).alias("e"), F.count("x").alias("n")).first()
    assert off["n"] == n and off["e"] < 1e-9
    assert conjugate_gradients(m, rhs.withColumn("b", F.lit(0.0)), 0.5).agg(F.max(F.abs("x"))).first()[0] == 0.0
    assert conjugate_gradients(m, rhs.limit(0)).count() == 0


def test_variogram_fit_recovers_parameters(spark):
    h = np.linspace(0.2, 10, 40)
    vg = spark.createDataFrame(pd.DataFrame({"h": h, "gamma": 1.0 + 4.0 * (1 - np.exp(-h / 2.0))}))
    r = Tr.variogram_fit(vg, {"range": (0.5, 5.0), "sill": (1.0, 9.0), "nugget": (0.0, 3.0)}, rounds=4).first()
    assert (r["range"], r["sill"], r["nugget"]) == pytest.approx((2.0, 4.0, 1.0), rel=0.01)


def test_cross_validation_covers_every_row_once_per_model(spark, field):
    df, pdf = field
    folds = df.withColumn("fold", (F.col("id") % 4 + 1).cast("int"))
    p = {"range": 2.0, "sill": 1.0, "nugget": 0.2}
    r = Kr.cross_validate(folds, "id", "fold", 4, {"a": p, "b": {**p, "range": 1.0}}, x="x", y="y", z="z", k=5)
    assert r.count() == 2 * len(pdf) and r.select("id", "model").distinct().count() == 2 * len(pdf)


def test_subset_posterior_orders_quantiles(spark, field):
    df, _ = field
    r = Kr.subset_combine(df.where("id % 6 <> 0"), df.where("id % 6 = 0"), "id", "id", 3, {"range": 2.0, "sill": 1.0, "nugget": 0.2},
                          x="x", y="y", z="z", k=5).toPandas()
    assert len(r) == 40 and (r["q_lower"] <= r["q50"]).all() and (r["q50"] <= r["q_upper"]).all()


def test_resume_keeps_finished_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([("m1", 1, 1.0), ("m1", 2, 2.0)], "model string, fold int, v double")
    Tb.write_results(a, path, keys=["model", "fold"])
    tasks = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 1)], "model string, fold int")
    left = Tb.unfinished(tasks, spark.read.parquet(path), ["model", "fold"])
    assert [(r["model"], r["fold"]) for r in left.collect()] == [("m2", 1)]
    Tb.write_results(left.withColumn("v", F.lit(9.0)), path, keys=["model", "fold"])
    assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = V.table(spark, SF, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev.repartition(5).write.parquet(src)
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    s = ingest_stream(spark, src, schema, [F.col("value") > 20], max_files=1)
    agg = running_binned_scores(s, "ts", "60 days", "1 day", ["event_type"], ["value"])

    def save(batch, i):
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)

    q = agg.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.select("batch").distinct().count() >= 5
    got = rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n")).toPandas().sort_values(["day", "event_type"])
    want = ev.where("value > 20").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").count().toPandas().sort_values(["day", "event_type"])
    assert (got["n"].to_numpy() == want["count"].to_numpy()).all()
