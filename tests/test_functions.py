"""Scalar functions against fixed points and hand-made tables."""
import math

import pytest
from pyspark.sql import functions as F

from spatialscore.functions import binning as B
from spatialscore.functions import draws as D
from spatialscore.functions import projections as P
from spatialscore.functions import transforms as T
from spatialscore.functions.normal import norm_cdf, norm_pdf, norm_ppf_const
from spatialscore.operators import scoring as Sc


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).cast("double").alias(k) if not isinstance(v, list) else F.array(
        *[F.lit(float(x)) for x in v]).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("z", [-40.0, -8.0, -7.0, -1.96, -0.3, 0.0, 0.5, 1.0, 2.5758, 7.2, 38.0])
def test_norm_cdf_matches_erf(spark, z):
    assert one(spark, norm_cdf("z"), z=z) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-15)


def test_normal_null_pdf_and_quantile(spark):
    assert one(spark, norm_cdf(F.lit(None).cast("double"))) is None
    assert one(spark, norm_pdf("z"), z=0.0) == pytest.approx(1 / math.sqrt(2 * math.pi))
    assert norm_ppf_const(0.975) == pytest.approx(1.959963984540054)


def test_right_closed_bins(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.1,), (-0.1,), (None,)], "d double")
    got = [r[0] for r in d.select(B.right_closed_bin("d", [0, 1, 2])).collect()]
    assert got == [1, 1, 2, 2, None, None, None]


def test_even_bins_keep_the_largest_value(spark):
    top = 7.0605
    w = top / 9
    d = spark.createDataFrame([(0.0,), (w,), (top,), (top * 1.01,)], "d double")
    got = [r[0] for r in d.select(B.even_bin("d", F.lit(0.0), F.lit(w), 9, F.lit(top))).collect()]
    assert got == [1, 1, 9, None]


def test_snap_ties_go_up_and_ends_clamp(spark):
    d = spark.createDataFrame([(-5.0,), (1.0,), (2.0,), (2.1,), (99.0,)], "d double")
    assert [r[0] for r in d.select(B.snap_to_knots("d", [0, 2, 4])).collect()] == [0.0, 2.0, 2.0, 2.0, 4.0]


def test_logit_round_trips(spark):
    assert one(spark, T.expit(T.logit("p")), p=0.3) == pytest.approx(0.3)
    assert one(spark, T.shrunk_expit(T.shrunk_logit("p")), p=1.0) == pytest.approx(1.0)
    assert one(spark, T.expit("x"), x=500.0) == 1.0
    back = one(spark, T.multi_expit(T.multi_logit("a")), a=[0.2, 0.5])
    assert back == pytest.approx([0.2, 0.5])


def test_layer_weight_limits(spark):
    assert one(spark, T.layer_weights(3, "nu"), nu=0.0) == pytest.approx([1 / 3] * 3)
    assert one(spark, T.layer_weights(3, "nu"), nu=float("inf")) == [1.0, 0.0, 0.0]
    assert one(spark, T.layer_weights(2, "nu"), nu=0.5) == pytest.approx([2 / 3, 1 / 3])


def test_projections_invert(spark):
    e, n = P.tmerc("lon", "lat")
    r = spark.createDataFrame([(36.8, -1.3)], "lon double, lat double").select(e.alias("e"), n.alias("n"))
    lon, lat = P.tmerc("e", "n", inverse=True)
    b = r.select("e", "n", lon.alias("lon"), lat.alias("lat")).first()
    assert (b["lon"], b["lat"]) == pytest.approx((36.8, -1.3), abs=1e-9)
    # Central meridian, equator: the false origin.
    e0, n0 = P.tmerc("lon", "lat")
    z = spark.createDataFrame([(39.0, 0.0)], "lon double, lat double").select(e0.alias("e"), n0.alias("n")).first()
    assert (z["e"], z["n"]) == pytest.approx((500.0, 10000.0))
    x, y = P.lcc("lon", "lat")
    o = spark.createDataFrame([(-96.0, 39.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    assert (o["x"], o["y"]) == pytest.approx((0.0, 0.0), abs=1e-9)


@pytest.mark.parametrize("draws,truth,want", [([1, 2, 3], 2, 2 / 9), ([1, 2, 3], 0, 14 / 9), ([5], 2, 3.0), ([4, 4, 4], 4, 0.0)])
def test_ensemble_crps(spark, draws, truth, want):
    got = one(spark, D.ensemble_crps(D.sorted_draws("d"), F.col("y")), d=draws, y=truth)
    assert got == pytest.approx(want)


def test_single_draw_has_no_sd(spark):
    assert one(spark, D.sd_draws("d", F.lit(5.0)), d=[5]) is None


@pytest.mark.parametrize("y,want", [(1, 2.0), (3, 12.0), (0, 2.0), (2, 2.0)])
def test_interval_score(spark, y, want):
    assert one(spark, Sc.interval_score("y", F.lit(0.0), F.lit(2.0), 0.8), y=y) == pytest.approx(want)


def test_swapped_limits_are_put_right(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "a double, b double")
    r = Sc.with_interval(df, lower="a", upper="b").first()
    assert (r["_lower"], r["_upper"]) == (1.0, 3.0)


def test_population_variance_of_errors(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 3.0, 1.0)], "truth double, est double, sd double")
    r = Sc.score_agg(df, [], truth="truth", est="est", sd="sd").first()
    assert (r["bias"], r["var"], r["mse"]) == pytest.approx((2.0, 1.0, 5.0))


def test_strict_and_inclusive_coverage(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0, 2.0)], "truth double, est double, lo double, hi double")
    assert Sc.quick_check(df, [], "truth", "est", "lo", "hi", strict=True).first()["coverage"] == 0.0
    assert Sc.quick_check(df, [], "truth", "est", "lo", "hi", strict=False).first()["coverage"] == 1.0


def test_fuzzy_edges_by_hand(spark):
    # Ten draws 0,0,0,1..7: the 10 % quantile is 0 and P(draw = 0) = 0.3, so a truth of 0 is rejected by a third.
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 0.0)], "d array<double>, y double")
    r = Sc.single_scores(df, truth="y", draws="d", fuzzy=True).first()
    assert r["coverage"] == pytest.approx(1 - 1 / 3)
    assert r["width"] == pytest.approx(6.1 - 1 / 3)
