"""Areas, populations and blocks."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import as_col
from ..session import cut_lineage, written
from .ordering import group_quantiles, ordered


def block_id(x, y, xlim, ylim, mx: int = 3, my: int = 3):
    """1-based block (row-major from below), right-closed; below the range is the first block."""
    def axis(v, lim, m):
        lo, w = float(lim[0]), (float(lim[1]) - float(lim[0])) / m
        out = F.lit(None).cast("int")
        for i in reversed(range(1, m + 1)):
            out = F.when(as_col(v) <= F.lit(lo + i * w), F.lit(i)).otherwise(out)
        return out
    return (axis(y, ylim, my) - 1) * mx + axis(x, xlim, mx)


def block_aggregate(df: DataFrame, x: str, y: str, value: str, xlim, ylim, mx: int = 3, my: int = 3,
                    keys: list[str] = ()) -> DataFrame:
    """Equal-weight mean of grid points per block."""
    b = block_id(x, y, xlim, ylim, mx, my).alias("block")
    return df.groupBy(*keys, b).agg(F.count(value).alias("n"), F.avg(value).alias("value"))


def urban_threshold(pixels: DataFrame, area: str, pop: str, tie: str, pct_urban: str,
                    always_urban: tuple[str, ...] = ()) -> DataFrame:
    """Per area the first population at which the running sum reaches the rural total."""
    o = ordered(pixels.where(F.col(pop).isNotNull()), [area], pop, tie, sums={"_cum": pop})
    totals = pixels.groupBy(area).agg(F.sum(pop).alias("_total"), F.max(pct_urban).alias("_pct"))
    o = o.join(totals, area)
    hit = F.min(F.when(F.col("_cum") >= F.col("_total") * (F.lit(1.0) - F.col("_pct")), F.col(pop).cast("double")))
    return o.groupBy(area).agg(hit.alias("threshold")).withColumn(
        "threshold", F.when(F.col(area).isin(*always_urban), F.lit(float("-inf"))).otherwise(F.col("threshold"))
        if always_urban else F.col("threshold"))


def urban_flag(pixels: DataFrame, thresholds: DataFrame, area: str, pop: str) -> DataFrame:
    """Urban when the population is above the area's threshold; unmatched areas give NULL."""
    return pixels.join(thresholds, area, "left").withColumn("urban", F.col(pop) > F.col("threshold"))


def rescale_population(pixels: DataFrame, targets: DataFrame, keys: list[str], pop: str, target: str = "target") -> DataFrame:
    """Scale pixel populations so each stratum sums to its target; empty strata stay 0."""
    totals = pixels.groupBy(*keys).agg(F.sum(pop).alias("_total"))
    factor = F.when(F.col("_total") > 0, F.col(target) / F.col("_total")).otherwise(F.lit(0.0))
    ratio = totals.join(targets, keys, "left").select(*keys, factor.alias("_factor"))
    return pixels.join(ratio, keys, "left").withColumn("pop_adjusted", F.col(pop) * F.col("_factor")).drop("_factor")


def fraction_urban(pops: DataFrame, area: str, urban_pop: str, total_pop: str) -> DataFrame:
    """Share of the population that is urban."""
    return pops.groupBy(area).agg((F.sum(urban_pop) / F.nullif(F.sum(total_pop), F.lit(0.0))).alias("frac_urban"))


def stratum_targets(units: DataFrame, keys: list[str], households: str, persons: str) -> DataFrame:
    """Enumeration areas times mean households times mean persons."""
    return units.groupBy(*keys).agg(
        (F.count(F.lit(1)) * F.avg(households) * F.avg(persons)).alias("target"))


def area_truth(clusters: DataFrame, keys: list[str], y: str, n: str) -> DataFrame:
    """Sum y / sum n."""
    return clusters.groupBy(*keys).agg(
        (F.sum(y).cast("double") / F.nullif(F.sum(n).cast("double"), F.lit(0.0))).alias("truth"))


def area_per_observation(areas: DataFrame, obs: DataFrame, area: str, size: str, log: bool = True) -> DataFrame:
    """Area (or its log) per observation, joined by name."""
    counts = obs.groupBy(area).agg(F.count(F.lit(1)).alias("n_obs"))
    per = F.ln(size) - F.ln("n_obs") if log else F.col(size) / F.col("n_obs")
    return areas.join(counts, area).withColumn("area_per_obs", per)


def fan_out(pixels: DataFrame, rural: DataFrame, urban: DataFrame, area: str, value: str) -> DataFrame:
    """Give every pixel its area's result, urban pixels from the second table when it has one."""
    r = rural.select(area, F.col(value).alias("_r"))
    u = urban.select(area, F.col(value).alias("_u"))
    return pixels.join(r, area, "left").join(u, area, "left").withColumn(
        value, F.coalesce(F.when(F.col("urban"), F.col("_u")), F.col("_r"))).drop("_r", "_u")


@F.pandas_udf(DoubleType())
def _diameter(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Largest distance of two vertices of every ring: only hull vertices on opposite sides can have it."""
    def one(x, y):
        pts = np.column_stack([np.asarray(x, float), np.asarray(y, float)]) if x is not None and y is not None else np.empty((0, 2))
        if not len(pts) or not np.isfinite(pts).all():
            return None
        h = _hull(pts)
        n = len(h)
        if n < 4:
            return max(float(np.hypot(*(h - np.roll(h, k, axis=0)).T).max()) for k in range(n))
        side = np.roll(h, -1, axis=0) - h
        turn = np.unwrap(np.arctan2(side[:, 1], side[:, 0]))
        # The vertices across from a side are where the sides turn into its opposite direction; one more each way for ties.
        far = np.searchsorted(np.r_[turn, turn + 2 * np.pi], turn + np.pi)
        steps = [np.hypot(*(h[(np.arange(n) + e) % n] - h[(far + k) % n]).T).max() for e in (0, 1) for k in (-1, 0, 1)]
        return float(max(steps))
    return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=float)


def polygon_metrics(rings: DataFrame) -> DataFrame:
    """Per ring the shoelace area, half the largest vertex distance, mean vertex distance to the
    centroid and whether it is the largest ring of its area (first on ties)."""
    v = F.col("vertices")
    n = F.size(v)
    # A ring beside itself, moved by one vertex: every side is one element, so the work is linear in the vertices.
    sides = F.arrays_zip(v.alias("a"), F.concat(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, 1)).alias("b"))
    cross = F.transform(sides, lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    plus = lambda acc, t: acc + t
    dist = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    cx, cy = (F.aggregate(v[c], F.lit(0.0), plus) / n for c in "xy")
    base = rings.withColumns({"ring_area": F.abs(F.aggregate(cross, F.lit(0.0), plus)) / 2.0,
                              "radius": _diameter(v["x"], v["y"]) / 2.0, "_c": F.struct(cx.alias("x"), cy.alias("y"))})
    base = base.withColumn("mean_centre_dist", F.aggregate(
        F.transform(v, lambda a: dist(a, F.col("_c"))), F.lit(0.0), plus) / F.size(v)).drop("_c")
    largest = base.groupBy("area").agg(F.max(F.struct("ring_area", (-F.col("ring_id")).alias("r"))).alias("_l"))
    return base.join(largest, "area").withColumn("largest", F.col("ring_id") == -F.col("_l.r")).drop("_l", "vertices")


def domain_box(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Range and centre of coordinates."""
    return df.groupBy(*keys).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))


def covariate_knots(df: DataFrame, x: str, tie: str, n: int, quantiles: bool = False) -> DataFrame:
    """``n`` knots over the range of ``x``, evenly spaced or at quantiles."""
    if quantiles:
        probs = {f"k{i}": i / (n - 1) for i in range(n)}
        wide = group_quantiles(df, [], x, tie, probs)
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(i + 1).alias("knot"), F.col(f"k{i}").alias("position")) for i in range(n)])))
    lim = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    return lim.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("knot"), "lo", "hi").select(
        "knot", (F.col("lo") + (F.col("knot") - 1) * ((F.col("hi") - F.col("lo")) / (n - 1))).alias("position"))


#: Points of a sector that one task takes; a sector with more is split at its farthest point first.
SECTOR_POINTS = 50_000


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise, without points on its edges."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    turn = np.linspace(0.0, 2.0 * np.pi, 32, endpoint=False)
    frame = pts[[int(np.argmax(pts @ d)) for d in np.column_stack([np.cos(turn), np.sin(turn)])]]
    side = np.roll(frame, -1, axis=0) - frame
    inside = np.ones(len(pts), bool)
    margin = 1e-9 * max(float(np.ptp(pts)), 1e-300) ** 2
    for a, d in zip(frame, side):
        if d.any():  # what lies clearly inside of the frame can't be a vertex
            inside &= d[0] * (pts[:, 1] - a[1]) - d[1] * (pts[:, 0] - a[0]) > margin
    pts = pts[~inside]

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _outer(pos: float, ends: tuple, points: np.ndarray) -> pd.DataFrame:
    """Hull vertices strictly between the ends of a sector's chord, in order."""
    a, b = np.array(ends[:2]), np.array(ends[2:])
    h = _hull(np.vstack([points, a, b]))
    at = int(np.flatnonzero((h == a).all(axis=1))[0])
    h = np.roll(h, -at, axis=0)
    stop = int(np.flatnonzero((h == b).all(axis=1))[0])
    return pd.DataFrame({"pos": pos, "at": np.arange(1, stop), "x": h[1:stop, 0], "y": h[1:stop, 1]})


def _sectors(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [_outer(k[0], k[1:], g[["x", "y"]].to_numpy(float)) for k, g in pdf.groupby(["pos", "ax", "ay", "bx", "by"])]
    return pd.concat(parts) if parts else pd.DataFrame({"pos": [], "at": [], "x": [], "y": []})


def convex_hull(df: DataFrame, x: str, y: str, sector_points: int = SECTOR_POINTS) -> DataFrame:
    """Hull vertices (vertex, x, y) in counter-clockwise order from the leftmost, lowest one.

    The four extreme points give chords; only points outside of a chord can be vertices, and a point is outside of one
    at most. Every batch of a chord's points is cut to its own hull, then a chord with more than ``sector_points`` points
    is split at its farthest point, level by level, so a task has few points even if all of them are vertices. Points
    on an edge are no vertices; coordinates that are null or not finite take no part; repeated points count once.
    """
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)
    pts = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    corner = lambda a, b, sa, sb: F.max(F.struct((F.col(a) * sa).alias("p"), (F.col(b) * sb).alias("q"), "x", "y"))
    e = pts.agg(corner("x", "y", -1.0, -1.0).alias("e0"), corner("y", "x", -1.0, 1.0).alias("e1"),
                corner("x", "y", 1.0, 1.0).alias("e2"), corner("y", "x", 1.0, -1.0).alias("e3"))
    chord = lambda pos, width, a, b: F.struct(
        F.lit(pos).alias("pos"), F.lit(width).alias("width"), a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    chords = cut_lineage(e.where("e0 IS NOT NULL").select(F.inline(F.array(*[
        chord(float(i), 1.0, F.col(f"e{i}"), F.col(f"e{(i + 1) % 4}")) for i in range(4)]))))
    beyond = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    four = chords.agg(F.collect_list(F.struct(*chords.columns)).alias("c"))
    near = pts.select("x", "y", F.inline(four.scalar())).where(beyond < 0)
    schema = "pos double, at long, x double, y double"
    names = ["pos", "ax", "ay", "bx", "by"]

    def thin(batches):
        for pdf in batches:
            out = _sectors(pdf)
            yield out.merge(pdf.drop_duplicates("pos").drop(columns=["x", "y"]), on="pos")[["x", "y", "pos", "width", *names[1:]]]

    points = "x double, y double, pos double, width double, ax double, ay double, bx double, by double"
    near = written(near.mapInPandas(thin, points))
    while True:
        far = near.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("x", "y"), F.struct(
            -beyond, (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay")))).alias("f")).where(F.col("n") > sector_points)
        far = cut_lineage(far.select("pos", "f"))
        if far.isEmpty():
            break
        halves = F.array(*[F.struct((F.col("pos") + F.col("width") * t).alias("pos"), (F.col("width") / 2).alias("width"),
                                    a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
                           for t, a, b in ((0.0, (F.col("ax"), F.col("ay")), (F.col("f.x"), F.col("f.y"))), (0.5, (F.col("f.x"), F.col("f.y")), (F.col("bx"), F.col("by"))))])
        same = F.array(F.struct("pos", "width", "ax", "ay", "bx", "by"))
        parts = F.inline(F.when(F.col("f").isNull(), same).otherwise(halves))
        near = written(near.join(far, "pos", "left").select("x", "y", parts).where(beyond < 0))
        chords = cut_lineage(chords.join(far, "pos", "left").select(parts))
    inner = near.groupBy("pos").applyInPandas(_sectors, schema)
    # A chord begins with its first end; equal ends have no chord, but one point alone is its own hull.
    ends = chords.where("pos = 0 OR ax != bx OR ay != by").select("pos", F.lit(0).cast("long").alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    ends = ends.groupBy("x", "y").agg(F.min("pos").alias("pos"), F.min("at").alias("at")).select("pos", "at", "x", "y")
    every = cut_lineage(ends.unionByName(inner))
    order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = every.groupBy("pos").count().select("pos", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("at"))
    return every.withColumn("k", rank).join(offset, "pos").select((F.col("before") + F.col("k")).cast("long").alias("vertex"), "x", "y")
