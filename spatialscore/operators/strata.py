"""Scores by distance bin, stratum and model, and tables built from them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import even_bin, even_midpoint, right_closed_bin
from .ordering import group_quantiles, ordered, select_ranks
from .scoring import score_aggregates

SINGLE = ["err", "sq_err", "crps", "interval_score", "coverage", "width"]


def scalar(df: DataFrame, expr: Column) -> Column:
    """A one-row aggregate as a scalar subquery, so no join is planned."""
    return df.select(expr).scalar()


def even_distance_bins(single: DataFrame, dist: str, breaks: int = 30) -> tuple[DataFrame, Column]:
    """B1: ``breaks - 1`` right-closed bins from 0 to the largest distance."""
    with_w = single.withColumn("_top", scalar(single, F.max(dist).cast("double"))).withColumn("_w", F.col("_top") / F.lit(float(breaks - 1)))
    return with_w.withColumn("bin", even_bin(dist, F.lit(0.0), "_w", breaks - 1, "_top")).drop("_top"), F.col("_w")


def scores_by_even_distance(single: DataFrame, dist: str, breaks: int = 30, keys: list[str] = (),
                            pooled: bool = True) -> DataFrame:
    """B1: scores per distance bin; with ``pooled`` also one row over all bins, marked by ``pooled``.

    Rows without a distance have the bin NULL.
    """
    binned, w = even_distance_bins(single, dist, breaks)
    aggs = [F.count(F.lit(1)).alias("n_per_bin"), F.max("_w").alias("_w"), *score_aggregates()]
    sets = [[*keys, "bin"], [*keys]] if pooled else [[*keys, "bin"]]
    if pooled:
        out = binned.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, "bin")]).agg(
            (F.grouping("bin") == 1).alias("pooled"), *aggs)
    else:
        out = binned.groupBy(*keys, "bin").agg(*aggs)
    return out.withColumn("nn_dist", even_midpoint("bin", F.lit(0.0), "_w")).drop("_w")


def equal_count_distance(single: DataFrame, dist: str, tie: str, n_breaks: int | None = None,
                         n_per_bin: int | None = None, max_dist: float | None = None,
                         keys: list[str] = ()) -> DataFrame:
    """Give every row its equal-count bin (per key) and the bin's limits.

    Bin edges are the means of the two neighbouring distances at each seam, the first is 0 and the
    last the maximum plus 1e-6. A row goes to the bin of the first row with its distance, which is
    what right-closed bins on those edges give. With a given number of bins the edges are selected and
    few; with a given number of rows a bin they grow with the rows, so the rows themselves are ranked.
    """
    cut = single if max_dist is None else single.where(F.col(dist) < max_dist)
    keys = list(keys)
    if n_per_bin is None:
        return _given_number_of_bins(cut.where(F.col(dist).isNotNull()), dist, tie, n_breaks, keys)
    o = ordered(cut.where(F.col(dist).isNotNull()), keys, dist, tie)
    o = o.withColumn("_per", F.lit(n_per_bin).cast("bigint")).withColumn("bin", F.ceil(F.col("rank") / F.col("_per")).cast("int"))
    # Seam i lies between order positions i * per and i * per + 1.
    pos = (F.col("rn") - 1) % F.col("_per")
    last = (pos == F.col("_per") - 1) & (F.col("rn") < F.col("group_n"))
    first = (pos == 0) & (F.col("rn") > 1)
    seams = (
        o.where(last | first)
        .select(
            *keys, F.explode(F.filter(F.array(
                F.when(last, F.floor(F.col("rn") / F.col("_per"))),
                F.when(first, F.floor((F.col("rn") - 1) / F.col("_per"))),
            ), lambda v: v.isNotNull())).alias("seam"), F.col(dist).alias("_d"))
        .groupBy(*keys, "seam").agg(F.avg("_d").alias("edge"))
    )
    # A seam is the upper limit of its bin and the lower limit of the next.
    seam = F.col("seam").cast("int")
    none = F.lit(None).cast("double")
    limits = seams.select(*keys, F.inline(F.array(
        F.struct(seam.alias("bin"), F.col("edge").alias("_hi"), none.alias("_lo")),
        F.struct((seam + 1).alias("bin"), none.alias("_hi"), F.col("edge").alias("_lo"))))
    ).groupBy(*keys, "bin").agg(F.max("_hi").alias("_hi"), F.max("_lo").alias("_lo"))
    tops = cut.groupBy(*keys).agg((F.max(dist) + F.lit(1e-6)).alias("_top"))
    out = o.join(limits, [*keys, "bin"], "left")
    out = out.join(tops, keys) if keys else out.withColumn("_top", tops.scalar())
    return out.withColumns({
        "bin_low": F.coalesce("_lo", F.lit(0.0)), "bin_high": F.coalesce("_hi", "_top"),
    }).withColumn("nn_dist", F.col("bin_low") + (F.col("bin_high") - F.col("bin_low")) / 2.0).drop(
        "_hi", "_lo", "_top", "_per", "rn", "rank", "group_n")


def _given_number_of_bins(rows: DataFrame, dist: str, tie: str, n_breaks: int, keys: list[str]) -> DataFrame:
    """Equal-count bins from the selected distances at their seams; the rows are neither ordered nor stored."""
    def per(n: Column) -> Column:
        return F.ceil(n / F.lit(float(n_breaks))).cast("bigint")

    def ranks(n: Column) -> Column:
        both = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n_breaks)), lambda i: F.array(i * per(n), i * per(n) + 1)))
        return F.concat(F.filter(F.transform(both, lambda r: r.cast("bigint")), lambda r: r < n), F.array(n.cast("bigint")))

    at = select_ranks(rows, keys, dist, tie, ranks).withColumn("_per", per(F.col("group_n")))
    ends = (F.col("rn") % F.col("_per") == 0) & (F.col("rn") < F.col("group_n"))
    starts = ((F.col("rn") - 1) % F.col("_per") == 0) & (F.col("rn") > 1)
    side = lambda when, seam, d: F.when(when, F.struct(seam.cast("long").alias("seam"), d.alias("d")))
    d, before = F.col(dist), F.floor((F.col("rn") - 1) / F.col("_per"))
    sides = F.filter(F.array(side(ends, F.floor(F.col("rn") / F.col("_per")), d), side(starts, before, d),
                             side(F.col("rn") == F.col("group_n"), F.col("group_n"), d + F.lit(1e-6))), lambda v: v.isNotNull())
    edges = at.select(*keys, F.inline(sides)).groupBy(*keys, "seam").agg(F.avg("d").alias("edge"))
    ordered_edges = F.transform(F.array_sort(F.collect_list(F.struct("seam", "edge"))), lambda e: e["edge"])
    limits = edges.groupBy(*keys).agg(F.concat(F.array(F.lit(0.0)), ordered_edges).alias("_edges")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_edges")
    if keys:
        out = rows.join(limits, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])).drop(*[f"_k_{k}" for k in keys])
    else:
        out = rows.withColumn("_edges", limits.scalar())
    inner = F.slice("_edges", 2, F.size("_edges") - 2)
    out = out.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(dist))) + 1)
    out = out.withColumns({"bin_low": F.element_at("_edges", F.col("bin")), "bin_high": F.element_at("_edges", F.col("bin") + 1)})
    return out.withColumn("nn_dist", F.col("bin_low") + (F.col("bin_high") - F.col("bin_low")) / 2.0).drop("_edges")


def scores_by_distance(single: DataFrame, dist: str, tie: str, breaks: int | list[float] = 30,
                       kind: str = "quantiles", n_per_bin: int | None = None, max_dist: float | None = None,
                       keys: list[str] = (), scores: list[str] = tuple(SINGLE)) -> DataFrame:
    """Mean single scores by distance bin; kind is even, quantiles or n_per_bin."""
    if isinstance(breaks, (list, tuple)):
        top = min(max_dist or float("inf"), max(breaks))
        edges = [float(b) for b in breaks]
        mids = F.array(*[F.lit(a + (b - a) / 2.0) for a, b in zip(edges, edges[1:])])
        binned = single.where(F.col(dist) < top).withColumn("bin", right_closed_bin(dist, edges))
        binned = binned.withColumn("nn_dist", F.get(mids, F.col("bin") - 1))
    elif kind == "even":
        cut = single if max_dist is None else single.where(F.col(dist) < max_dist)
        binned, w = even_distance_bins(cut, dist, breaks)
        binned = binned.withColumn("nn_dist", even_midpoint("bin", F.lit(0.0), w))
    else:
        need = list(dict.fromkeys([*keys, dist, tie, *scores]))
        binned = equal_count_distance(single.select(*need), dist, tie, None if n_per_bin else breaks, n_per_bin, max_dist, keys)
    return binned.groupBy(*keys, "bin", "nn_dist").agg(
        F.count(F.lit(1)).alias("n_per_bin"), *[F.avg(s).alias(s) for s in scores])


def merge_binned(tables: list[DataFrame | None], bin_col: str, n_col: str, scores: list[str],
                 keys: list[str] = ()) -> DataFrame:
    """N-weighted mean of binned tables; tables may be missing, bins may be in some only."""
    present = [t.select(*keys, bin_col, n_col, *scores) for t in tables if t is not None]
    stacked = reduce(lambda a, b: a.unionByName(b), present)
    n = F.col(n_col)
    return stacked.groupBy(*keys, bin_col).agg(
        F.sum(n).alias(n_col),
        *[(F.sum(n * F.col(s)) / F.sum(F.when(F.col(s).isNotNull(), n))).alias(s) for s in scores])


def pool_bins(binned: DataFrame, n_col: str, scores: list[str], keys: list[str] = ()) -> DataFrame:
    """N-weighted mean over all bins."""
    n = F.col(n_col)
    return binned.groupBy(*keys).agg(
        F.sum(n).alias(n_col),
        *[(F.sum(n * F.col(s)) / F.sum(F.when(F.col(s).isNotNull(), n))).alias(s) for s in scores])


def scores_by_subset(single: DataFrame, keys: list[str], urban: str = "urban") -> DataFrame:
    """Pooled, urban and rural rows per key in one pass; ``subset`` is Avg, Urban, Rural or, without a stratum, NULL."""
    cols = [F.col(k) for k in keys]
    g = single.groupingSets([[*cols], [*cols, F.col(urban)]], *cols, F.col(urban)).agg(
        F.grouping(urban).alias("_all"), F.count(F.lit(1)).alias("n"), *score_aggregates())
    label = F.when(F.col("_all") == 1, "Avg").when(F.col(urban), "Urban").when(~F.col(urban), "Rural")
    return g.select(*keys, label.alias("subset"), "n", *[c for c in g.columns if c not in (*keys, urban, "_all", "n")])


def complete_subsets(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rule 13: every key gets all three subsets; an empty stratum has NULL scores and n = 0."""
    wanted = scores.select(*keys).distinct().withColumn(
        "subset", F.explode(F.array(F.lit("Avg"), F.lit("Urban"), F.lit("Rural"))))
    return wanted.join(scores, [*keys, "subset"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mean_over_folds(fold_scores: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Mean over folds, missing folds left out."""
    return fold_scores.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scores])


def conditional_mean(df: DataFrame, x: str, y: str, width: float, origin: float = 0.0,
                     keys: list[str] = ()) -> DataFrame:
    """Mean of ``y`` by right-closed bin of ``x`` of fixed width."""
    b = F.greatest(F.ceil((F.col(x) - origin) / F.lit(float(width))), F.lit(1).cast("bigint"))
    return (
        df.where(F.col(x).isNotNull() & (F.col(x) >= origin))
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count(y).alias("n"), F.avg(y).alias("mean_y"))
        .withColumn("centre", F.lit(float(origin)) + (F.col("bin") - 0.5) * F.lit(float(width)))
    )


def quilt(df: DataFrame, x: str, y: str, z: str, nx: int, ny: int) -> DataFrame:
    """Mean of ``z`` per cell of an nx by ny grid over the coordinate range."""
    lim = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    box = df.withColumns({c: lim.select(c).scalar() for c in ("x0", "x1", "y0", "y1")})
    ix = F.least(F.floor((F.col(x) - F.col("x0")) / ((F.col("x1") - F.col("x0")) / nx)), F.lit(nx - 1)) + 1
    iy = F.least(F.floor((F.col(y) - F.col("y0")) / ((F.col("y1") - F.col("y0")) / ny)), F.lit(ny - 1)) + 1
    return box.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(z).alias("n"), F.avg(z).alias("mean_z"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda c: c * (c - 1) / 2.0
    s = cells.agg(F.sum(pairs(F.col("c"))).alias("s_ab"), F.sum("c").alias("n"))
    sa = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("s_a"))
    sb = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("s_b"))
    expected = F.col("s_a") * F.col("s_b") / pairs(F.col("n"))
    return s.withColumns({"s_a": sa.scalar(), "s_b": sb.scalar()}).select(
        "n", ((F.col("s_ab") - expected) / ((F.col("s_a") + F.col("s_b")) / 2.0 - expected)).alias("adjusted_rand"))


def timing_shares(df: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Every stage as a share of the total, and the remainder."""
    used = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    return df.withColumns({
        **{f"{p}_share": F.col(p) / F.col(total) for p in parts},
        "other_share": (F.col(total) - used) / F.col(total),
    })


def score_spread(df: DataFrame, keys: list[str], metric: str, tie: str) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact and without one task per group."""
    return group_quantiles(df, keys, metric, tie,
                           {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})


def range_bins(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """``n`` equal-width right-closed bins over the range; the outer breaks lie 0.1 % outside."""
    lim = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    box = df.withColumns({c: lim.select(c).scalar() for c in ("_lo", "_hi")})
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n))
    above = reduce(lambda a, b: a + b, [
        F.when(F.col(col) > F.col("_lo") + F.lit(float(i)) * step, 1).otherwise(0) for i in range(1, n)], F.lit(1))
    return box.withColumn(out, F.when(F.col(col).isNotNull(), above)).drop("_lo", "_hi")


def stacked_subsets(single: DataFrame, dist: str, keys: list[str], combos: list[str], breaks: int) -> DataFrame:
    """Binned scores for every combination of observation set and prediction subset.

    ``combos`` name the distance columns (one per observation set); a row counts in the subset of all
    predictions and in its own.
    """
    own = F.when(F.col("urban"), F.lit("urban")).otherwise(F.lit("rural"))
    long = single.select("*", F.explode(F.array(F.lit("all"), own)).alias("pred_set"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("obs_set"), F.col(c).alias(dist)) for c in combos])))
    top = long.groupBy("obs_set", "pred_set").agg(F.max(dist).cast("double").alias("_top")).withColumn("_w", F.col("_top") / F.lit(float(breaks - 1)))
    binned = long.join(top, ["obs_set", "pred_set"]).withColumn("bin", even_bin(dist, F.lit(0.0), "_w", breaks - 1, "_top"))
    return binned.where(F.col("bin").isNotNull()).groupBy(*keys, "obs_set", "pred_set", "bin").agg(
        F.count(F.lit(1)).alias("n_per_bin"), F.max("_w").alias("_w"), *score_aggregates()).withColumn(
        "nn_dist", even_midpoint("bin", F.lit(0.0), "_w")).drop("_w")
