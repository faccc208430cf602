"""Views over the given tables: DataFrames for Spark and the same as SQL text for checking.

Coordinates, errors and strata follow from row keys, so every view grows with its table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import INV_SQRT_2PI, INV_SQRT_PI, norm_cdf_sql, norm_ppf_const
from ..operators.scoring import single_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _east(key):
    return ((F.col(key) * 7919) % 10007).cast("double") / 100


def _north(key):
    return ((F.col(key) * 104729) % 10009).cast("double") / 100


def obs(spark, sf_dir) -> DataFrame:
    """One point per order with its area, region, stratum and value."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    o = o.select("o_orderkey", "o_custkey", "o_totalprice")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(
        r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("unit"), _east("o_orderkey").alias("east"),
        _north("o_orderkey").alias("north"), F.col("n_name").alias("county"), F.col("r_name").alias("region"),
        (F.col("o_orderkey") % 3 == 0).alias("urban"), (F.col("o_orderkey") % 4 - 1).alias("quality"),
        (F.col("o_totalprice") / 1000).alias("truth"), (F.col("o_orderkey") % 30 + 1).alias("n"))


def points(spark, sf_dir) -> DataFrame:
    """The obs points without the joins, for work that needs places and values only."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), _east("o_orderkey").alias("east"), _north("o_orderkey").alias("north"),
        (F.col("o_orderkey") % 3 == 0).alias("urban"), (F.col("o_totalprice") / 1000).alias("truth"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("train").alias("role"))


def preds(spark, sf_dir) -> DataFrame:
    """Gaussian predictions of three models for every obs point."""
    models = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for k, m in enumerate("ABC")]))
    p = obs(spark, sf_dir).select("*", models)
    # The odd factor keeps means off exact halves, where two engines may round apart.
    est = F.col("truth") + (((F.col("id") * 31 + F.col("k") * 577) % 2001 - 1000).cast("double") / 1000) * (10 + 5 * F.col("k")) * F.lit(1.0123456789)
    return p.select(
        "id", "model", "county", "region", "urban", "east", "north", "truth", est.alias("est"),
        (10 + (F.col("id") + F.col("k")) % 7).cast("double").alias("sd"), (F.col("id") % 8).alias("fold"),
        ((F.col("id") * 7) % 997).cast("double").alias("dist100")).withColumn("dist", F.col("dist100") / 100).drop("dist100")


def single(spark, sf_dir) -> DataFrame:
    """Per-row scores of preds at the 80 % level."""
    return single_scores(preds(spark, sf_dir), truth="truth", est="est", sd="sd")


def draws(spark, sf_dir) -> DataFrame:
    """64 draws per location, area and weight."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.col("label").alias("area"), F.col("embedding").cast("array<double>").alias("draws"),
        (F.col("label") / 50.0 - 0.1).alias("truth"), (1 + F.col("vec_id") % 5).cast("double").alias("w"))


def counts(spark, sf_dir) -> DataFrame:
    """Draws rounded to one decimal, so that ties and edges occur."""
    return draws(spark, sf_dir).withColumns({
        "draws": F.transform("draws", lambda v: F.floor(v * 10.0 + 0.5) / 10.0),
        "truth": F.floor(F.col("truth") * 10.0 + 0.5) / 10.0})


def grid(spark, sf_dir) -> DataFrame:
    """Raster of 100 columns; rows grow with the orders; one tenth of the customers' cells is missing."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") % 100).alias("ix"), F.floor(F.col("o_orderkey") / 100).alias("iy"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice") / 1000).alias("value"),
        (F.col("o_totalprice") / 1000).alias("truth"))


def pixels(spark, sf_dir) -> DataFrame:
    """Population pixels: one per customer, with area, target urban share and place."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("pixel"), F.col("n_name").alias("county"), F.col("r_name").alias("region"),
        (1 + (F.col("c_custkey") * 37) % 1000).alias("pop"),
        ((F.col("n_nationkey") % 5 + 1) / 10.0).alias("pct_urban"), _east("c_custkey").alias("east"),
        _north("c_custkey").alias("north"), (F.col("c_custkey") % 3 == 0).alias("urban"))


def swath(spark, sf_dir) -> DataFrame:
    """Scan observations with time, quality and place."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("model"), "value",
        (F.col("event_id") % 4 - 1).alias("quality"), (F.col("user_id") % 10).alias("bin"),
        ((F.col("event_id") * 7919) % 3600).cast("double").alias("lon10"),
        ((F.col("event_id") * 104729) % 1800).cast("double").alias("lat10")).select(
        "id", "ts", "model", "value", "quality", "bin", (F.col("lon10") / 10 - 180).alias("lon"),
        (F.col("lat10") / 10 - 90).alias("lat"))


# Vertices of the two area shapes in units of half the radius (a hexagon and a concave L).
HEXAGON = [(2, 0), (1, 2), (-1, 2), (-2, 0), (-1, -2), (1, -2)]
ELL = [(-2, -2), (2, -2), (2, 0), (0, 0), (0, 2), (-2, 2)]
HOLE = [(-1, -1), (0, -1), (0, 0), (-1, 0)]


def rings(spark, sf_dir) -> DataFrame:
    """One area per supplier; every fifth has a second ring (a hole), every second is concave."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("area"), _east("s_suppkey").alias("cx"), _north("s_suppkey").alias("cy"),
        ((F.col("s_suppkey") % 5 + 3).cast("double") / 2).alias("h"))

    def shape(vs):
        return F.array(*[F.struct((F.col("cx") + F.col("h") * float(a)).alias("x"),
                                  (F.col("cy") + F.col("h") * float(b)).alias("y")) for a, b in vs])

    outer = F.struct(F.lit(1).alias("ring_id"), F.when(F.col("area") % 2 == 0, shape(ELL)).otherwise(shape(HEXAGON)).alias("vertices"))
    hole = F.struct(F.lit(2).alias("ring_id"), shape(HOLE).alias("vertices"))
    return s.select("area", F.inline(F.when(F.col("area") % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer))))


# --- the same as SQL ------------------------------------------------------------------------------

def east_sql(k):
    return f"CAST(({k} * 7919) % 10007 AS DOUBLE) / 100"


def north_sql(k):
    return f"CAST(({k} * 104729) % 10009 AS DOUBLE) / 100"


def crps_sql(y: str, m: str, s: str) -> str:
    z = f"(({y} - {m}) / {s})"
    return (f"({s} * ({z} * (2e0 * {norm_cdf_sql(z)} - 1e0) + 2e0 * {INV_SQRT_2PI!r}::DOUBLE * exp(-0.5::DOUBLE * {z} * {z})"
            f" - {INV_SQRT_PI!r}::DOUBLE))")


def interval_score_sql(y: str, lo: str, hi: str, significance: float = 0.8) -> str:
    f = f"{2.0 / (1.0 - significance)!r}::DOUBLE"
    return (f"(({hi} - {lo}) + CASE WHEN {y} < {lo} THEN {f} * ({lo} - {y}) ELSE 0 END"
            f" + CASE WHEN {y} > {hi} THEN {f} * ({y} - {hi}) ELSE 0 END)")


Z80 = f"{norm_ppf_const(0.9)!r}::DOUBLE"


def _ring_sql(vs) -> str:
    return "[" + ", ".join(f"{{'x': cx + h * {a}, 'y': cy + h * {b}}}" for a, b in vs) + "]"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), f"""
        SELECT o_orderkey AS id, c_custkey AS unit, {east_sql('o_orderkey')} AS east, {north_sql('o_orderkey')} AS north,
               n_name AS county, r_name AS region, (o_orderkey % 3 = 0) AS urban, o_orderkey % 4 - 1 AS quality,
               o_totalprice / 1000 AS truth, o_orderkey % 30 + 1 AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "points": ((), f"""
        SELECT o_orderkey AS id, {east_sql('o_orderkey')} AS east, {north_sql('o_orderkey')} AS north,
               (o_orderkey % 3 = 0) AS urban, o_totalprice / 1000 AS truth,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE 'train' END AS role FROM orders"""),
    "preds": (("obs",), """
        SELECT id, m.model, county, region, urban, east, north, truth,
               truth + (CAST((id * 31 + m.k * 577) % 2001 - 1000 AS DOUBLE) / 1000) * (10 + 5 * m.k) * 1.0123456789::DOUBLE AS est,
               CAST(10 + (id + m.k) % 7 AS DOUBLE) AS sd, id % 8 AS fold,
               CAST((id * 7) % 997 AS DOUBLE) / 100 AS dist
        FROM obs CROSS JOIN (SELECT 'A' AS model, 0 AS k UNION ALL SELECT 'B', 1 UNION ALL SELECT 'C', 2) AS m"""),
    "single": (("preds",), f"""
        SELECT *, est - truth AS err, (est - truth) * (est - truth) AS sq_err, abs(est - truth) AS abs_err,
               {crps_sql('truth', 'est', 'sd')} AS crps,
               {interval_score_sql('truth', '(est - ' + Z80 + ' * sd)', '(est + ' + Z80 + ' * sd)')} AS interval_score,
               CASE WHEN est - {Z80} * sd <= truth AND truth <= est + {Z80} * sd THEN 1e0 ELSE 0e0 END AS coverage,
               (est + {Z80} * sd) - (est - {Z80} * sd) AS width
        FROM preds"""),
    "draws": ((), """
        SELECT vec_id, label AS area, CAST(embedding AS DOUBLE[]) AS draws, label / 50e0 - 0.1::DOUBLE AS truth,
               CAST(1 + vec_id % 5 AS DOUBLE) AS w FROM embeddings"""),
    "long_draws": (("draws",), """
        SELECT vec_id, area, truth, w, unnest(draws) AS v, unnest(range(1, len(draws) + 1)) AS i FROM draws"""),
    "counts": (("draws",), """
        SELECT vec_id, area, w, list_transform(draws, lambda v: floor(v * 10e0 + 0.5::DOUBLE) / 10e0) AS draws,
               floor(truth * 10e0 + 0.5::DOUBLE) / 10e0 AS truth FROM draws"""),
    "grid": ((), """
        SELECT o_orderkey % 100 AS ix, o_orderkey // 100 AS iy,
               CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice / 1000 END AS value, o_totalprice / 1000 AS truth FROM orders"""),
    "pixels": ((), f"""
        SELECT c_custkey AS pixel, n_name AS county, r_name AS region, 1 + (c_custkey * 37) % 1000 AS pop,
               (n_nationkey % 5 + 1) / 10e0 AS pct_urban, {east_sql('c_custkey')} AS east,
               {north_sql('c_custkey')} AS north, (c_custkey % 3 = 0) AS urban
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "swath": ((), """
        SELECT event_id AS id, ts, event_type AS model, value, event_id % 4 - 1 AS quality, user_id % 10 AS bin,
               CAST((event_id * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon,
               CAST((event_id * 104729) % 1800 AS DOUBLE) / 10 - 90 AS lat FROM events"""),
    "rings": ((), f"""
        SELECT area, 1 AS ring_id, CASE WHEN area % 2 = 0 THEN {_ring_sql(ELL)} ELSE {_ring_sql(HEXAGON)} END AS vertices
        FROM shapes UNION ALL SELECT area, 2, {_ring_sql(HOLE)} FROM shapes WHERE area % 5 = 0"""),
    "shapes": ((), f"""
        SELECT s_suppkey AS area, {east_sql('s_suppkey')} AS cx, {north_sql('s_suppkey')} AS cy,
               CAST(s_suppkey % 5 + 3 AS DOUBLE) / 2 AS h FROM supplier"""),
    "edges": (("rings",), """
        SELECT area, ring_id, unnest(vertices) AS a,
               unnest(list_concat(vertices[2:], vertices[1:1])) AS b FROM rings"""),
}
VIEWS["rings"] = (("shapes",), VIEWS["rings"][1])


def with_views(names: list[str], body: str, ctes: str = "") -> str:
    """Prefix ``body`` with the views it needs, in dependency order, and further CTEs."""
    done: dict[str, str] = {}

    def add(n):
        for d in VIEWS[n][0]:
            add(d)
        done.setdefault(n, VIEWS[n][1])

    for n in names:
        add(n)
    parts = [f"{n} AS ({' '.join(s.split())})" for n, s in done.items()] + ([ctes] if ctes else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body
