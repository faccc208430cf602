"""Rings cut into grid cells, so that a point meets the segments of its own cell only.

The test is the half-open crossing test: a point is inside if an odd number of edges span its height and cross it to the
right of the point. For the points of one cell, edges to the left never count. An edge to the right counts if exactly one
of its ends lies above the point, so over all of them the ends decide, and ends of equal height cancel in pairs: the ends
above the cell add a constant, those below nothing, and only where a ring leaves a row of cells between two cells of it is
a height left to compare. A cell therefore keeps a parity, few heights and the segments that it may itself be cut by.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_buckets

#: Cells per side of a ring's box: two for each unit of the root of its number of vertices, within these bounds.
FEWEST, MOST = 8, 256
#: Rounding slack around a segment, in cells.
SLACK = 1e-6


def ring_cells(rings: DataFrame) -> DataFrame:
    """(glvl, gx, gy, area, ring_id, odd, heights, own) of every cell that holds some of a ring's inside or border.

    ``rings`` has ``area, ring_id, vertices ARRAY<STRUCT<x,y>>``. Cells have the side 2^glvl, which follows from the ring's
    box and number of vertices; ``odd`` is the parity of all that lies to the right, ``heights`` and ``own`` what is left.
    """
    v = F.col("vertices")
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    box = rings.where(F.size(v) > 2).select("area", "ring_id", "vertices", F.array_min(xs).alias("rx0"), F.array_max(xs).alias("rx1"),
                                            F.array_min(ys).alias("ry0"), F.array_max(ys).alias("ry1"))
    ext = F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"), F.lit(1e-9))
    sides = F.least(F.greatest(2.0 * F.sqrt(F.size(v).cast("double")), F.lit(float(FEWEST))), F.lit(float(MOST)))
    box = box.withColumn("glvl", F.ceil(F.log2(ext / sides)).cast("int")).withColumn("s", F.pow(F.lit(2.0), F.col("glvl")))
    cell = lambda c: F.floor(c / F.col("s")).cast("bigint")
    nexts = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
    pairs = F.zip_with(v, nexts, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    ring = ["area", "ring_id", "glvl", "gy"]
    edges = box.select("area", "ring_id", "glvl", "s", cell(F.col("rx0")).alias("g0"), cell(F.col("rx1")).alias("g1"), F.inline(pairs)).where("ay <> by")
    edges = edges.select("*", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))).alias("gy"))
    # The part of the edge within its row of cells, and the cells that it may pass there.
    low, high = F.col("gy") * F.col("s"), (F.col("gy") + 1) * F.col("s")
    at = lambda y: F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    ends = [at(F.greatest(low, F.least("ay", "by"))), at(F.least(high, F.greatest("ay", "by")))]
    inside = lambda c: F.least(F.greatest(c, F.col("g0")), F.col("g1"))
    edges = edges.select(*ring, "g0", "g1", low.alias("low"), high.alias("high"), "ax", "ay", "bx", "by",
                         inside(cell(F.least(*ends) - F.col("s") * SLACK)).alias("c0"), inside(cell(F.greatest(*ends) + F.col("s") * SLACK)).alias("c1"))
    own = edges.select(*ring, F.explode(F.sequence("c0", "c1")).alias("gx"), F.struct("ax", "ay", "bx", "by").alias("e"))
    own = own.groupBy(*ring, "gx").agg(F.collect_list("e").alias("own"))
    # Ends by the first cell that their edge may pass: to the left of it the edge is on the right.
    end = edges.select(*ring, "g0", "g1", "low", "high", "c0", F.explode(F.array("ay", "by")).alias("y")).where(F.col("y") > F.col("low"))
    end = end.withColumn("y", F.when(F.col("y") < F.col("high"), F.col("y")))
    single = end.groupBy(*ring, "g0", "g1", "c0", "y").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    row = single.groupBy(*ring, "g0", "g1").agg(F.collect_list(F.struct("c0", "y")).alias("ends"))
    row = row.select(*ring, "ends", F.explode(F.sequence("g0", "g1")).alias("gx"))
    right = F.filter("ends", lambda e: e["c0"] > F.col("gx"))
    mid = F.transform(F.filter(right, lambda e: e["y"].isNotNull()), lambda e: e["y"])
    left = F.filter(F.array_distinct("mid"), lambda y: F.size(F.filter("mid", lambda z: z == y)) % 2 == 1)
    row = row.select(*ring, "gx", (F.size(F.filter(right, lambda e: e["y"].isNull())) % 2 == 1).alias("odd"), mid.alias("mid"))
    row = row.select(*ring, "gx", "odd", left.alias("heights"))
    every = own.join(row, [*ring, "gx"], "full").select(
        "glvl", "gx", "gy", "area", "ring_id", F.coalesce("odd", F.lit(False)).alias("odd"),
        F.coalesce("heights", F.array().cast("array<double>")).alias("heights"), "own")
    return every.where(F.col("odd") | (F.size("heights") > 0) | F.col("own").isNotNull())


def inside_cell(x: str, y: str) -> Column:
    """Whether a point lies inside the ring of its cell's row of :func:`ring_cells`."""
    above = F.aggregate("heights", F.col("odd"), lambda acc, h: acc != (h > F.col(y)))

    def crossed(acc: Column, e: Column) -> Column:
        spans = (e["ay"] > F.col(y)) != (e["by"] > F.col(y))
        # Evaluated only when the edge spans the point's height, so the divisor is not 0.
        at = e["ax"] + (F.col(y) - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
        return F.when(spans & (F.col(x) < at), ~acc).otherwise(acc)

    return F.when(F.col("own").isNull() & (F.size("heights") == 0), F.col("odd")).otherwise(
        F.aggregate(F.coalesce("own", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")), above, crossed))


def points_in_rings(points: DataFrame, rings: DataFrame, x: str, y: str) -> DataFrame:
    """(columns of points, area, ring_id) of the rings that hold a point: one equi join on cells, a cell for each side in use."""
    cells = ring_cells(rings)
    sides = sorted(r[0] for r in cells.select("glvl").distinct().collect())  # one number per size class of rings
    levels = F.array(*[F.struct(F.lit(u).alias("glvl"), F.lit(2.0**u).alias("s")) for u in sides or [0]])
    at = lambda c: F.floor(F.col(c) / F.col("s")).cast("bigint")
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("*", F.inline(levels)).withColumns({"gx": at(x), "gy": at(y)})
    hit = placed.join(cells, ["glvl", "gx", "gy"]).where(inside_cell(x, y))
    return hit.select(*points.columns, "area", "ring_id")


#: Partly covered areas of a cell that one row lists, and halvings between the widths of whole stretches of cells.
LISTED, HALVINGS = 64, 2


def _boxes(rings: DataFrame, n: int, domain: float) -> DataFrame:
    """(area, glvl, s, g0, g1): side of the cells of an area and its first and last column of them.

    ``n`` points on ``domain`` square units are expected; the more of them in an area's box, the finer its cells, so that
    cells along its border and points in them grow alike.
    """
    v = F.col("vertices")
    axis = lambda c: F.transform(v, lambda p: p[c])
    box = rings.groupBy("area").agg(
        F.min(F.array_min(axis("x"))).alias("rx0"), F.max(F.array_max(axis("x"))).alias("rx1"), F.min(F.array_min(axis("y"))).alias("ry0"),
        F.max(F.array_max(axis("y"))).alias("ry1"), F.sum(F.size(v)).cast("double").alias("size"))
    ext = F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"), F.lit(1e-9))
    expected = F.lit(float(n)) * F.least(F.lit(1.0), ext * ext / F.lit(max(domain, 1e-18)))
    sides = F.least(F.greatest(2.0 * F.sqrt("size"), F.sqrt(expected) / 2.0, F.lit(float(FEWEST))), F.lit(float(MOST)))
    box = box.withColumn("glvl", F.ceil(F.log2(ext / sides)).cast("int")).withColumn("s", F.pow(F.lit(2.0), F.col("glvl")))
    cell = lambda c: F.floor(c / F.col("s")).cast("bigint")
    return box.select("area", "glvl", "s", cell(F.col("rx0")).alias("g0"), cell(F.col("rx1")).alias("g1"))


def _stretches(rings: DataFrame, box: DataFrame) -> DataFrame:
    """(area, glvl, gy, a, b, odd, heights, own): stretches of cells a to b of a row that are alike to the rings of an area.

    All rings of an area are tested together, since a point in an odd number of them meets an odd number of all their edges.
    """
    v = F.col("vertices")
    cell = lambda c: F.floor(c / F.col("s")).cast("bigint")
    nexts = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
    pairs = F.zip_with(v, nexts, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    # An area's box joins its rings before these become edges, and by shuffle: Spark does not know how many edges a row
    # will hold and would collect all of them on the driver to broadcast them.
    edges = rings.join(box.hint("merge"), "area").select(*box.columns, F.inline(pairs)).where("ay <> by")
    edges = edges.select("*", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))).alias("gy"))
    low, high = F.col("gy") * F.col("s"), (F.col("gy") + 1) * F.col("s")
    at = lambda y: F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    ends = [at(F.greatest(low, F.least("ay", "by"))), at(F.least(high, F.greatest("ay", "by")))]
    inside = lambda c: F.least(F.greatest(c, F.col("g0")), F.col("g1"))
    first, last = inside(cell(F.least(*ends) - F.col("s") * SLACK)), inside(cell(F.greatest(*ends) + F.col("s") * SLACK))
    # Few bytes become many cells, so the number of tasks is not left to the size.
    edges = edges.repartition(default_buckets(rings.sparkSession), "area", "gy")
    rows = edges.groupBy("area", "glvl", "s", "g0", "g1", "gy").agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by", first.alias("c0"), last.alias("c1"))).alias("es"))
    # Between two of these cells neither the edges of a cell nor those to the right of it change.
    turns = F.concat(F.array("g0"), F.transform("es", lambda e: e["c0"]), F.transform("es", lambda e: e["c1"] + 1))
    turns = F.array_sort(F.array_distinct(F.filter(turns, lambda c: c <= F.col("g1"))))
    rows = rows.withColumn("t", turns).select("area", "glvl", "gy", "es", low.alias("low"), high.alias("high"), F.inline(F.zip_with(
        "t", F.concat(F.slice("t", 2, F.size("t")), F.array(F.col("g1") + 1)), lambda a, b: F.struct(a.alias("a"), (b - 1).alias("b")))))
    right = F.filter("es", lambda e: e["c0"] > F.col("a"))
    rows = rows.withColumn("tops", F.filter(F.flatten(F.transform(right, lambda e: F.array(e["ay"], e["by"]))), lambda y: y > F.col("low")))
    own = F.transform(F.filter("es", lambda e: (e["c0"] <= F.col("a")) & (e["c1"] >= F.col("a"))),
                      lambda e: F.struct(*[e[c].alias(c) for c in ("ax", "ay", "bx", "by")]))
    rows = rows.select("area", "glvl", "gy", "a", "b", own.alias("own"), (F.size(F.filter("tops", lambda y: y >= F.col("high"))) % 2 == 1).alias("odd"),
                       F.filter("tops", lambda y: y < F.col("high")).alias("mid"))
    heights = F.filter(F.array_distinct("mid"), lambda y: F.size(F.filter("mid", lambda z: z == y)) % 2 == 1)
    return rows.select("area", "glvl", "gy", "a", "b", "odd", heights.alias("heights"), "own")


def _within(p: Column, x: str, y: str) -> Column:
    """Whether a point of a cell lies inside an area that the cell lists (:func:`inside_cell` for a struct)."""
    def crossed(acc: Column, e: Column) -> Column:
        spans = (e["ay"] > F.col(y)) != (e["by"] > F.col(y))
        at = e["ax"] + (F.col(y) - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
        return F.when(spans & (F.col(x) < at), ~acc).otherwise(acc)

    return F.aggregate(p["own"], F.aggregate(p["heights"], p["odd"], lambda acc, h: acc != (h > F.col(y))), crossed)


def areas_at_points(points: DataFrame, rings: DataFrame, pid: str, x: str, y: str) -> DataFrame:
    """(pid, area, n_areas) of the points that lie in an area: the first area and the number of areas.

    Cells wholly inside an area only add to a count and a least area, which are kept for stretches of 4^k cells and summed
    for the cells in use, so a point never meets the areas around it one by one. The other cells list their areas with what
    is left to test. A point then meets a row or two for each side in use, however many areas overlap.
    """
    placed = points.select(pid, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px IS NOT NULL AND py IS NOT NULL")
    r = placed.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("px", "py")]).first()
    domain = (r["max_px"] - r["min_px"]) * (r["max_py"] - r["min_py"]) if r["n"] else 0.0
    rings = rings.where(F.size("vertices") > 2)
    box = _boxes(rings, r["n"], domain)
    parts = _stretches(rings, box)
    sides = sorted(u[0] for u in box.select("glvl").distinct().collect())  # one number per size class of areas
    levels = F.array(*[F.struct(F.lit(u).alias("glvl"), F.lit(2.0**u).alias("s")) for u in sides or [0]])
    at = lambda c: F.floor(F.col(c) / F.col("s")).cast("bigint")
    placed = placed.select("*", F.inline(levels)).select(pid, "px", "py", "glvl", at("px").alias("gx"), at("py").alias("gy"))
    cell = ["glvl", "gx", "gy"]
    plain = (F.size("own") == 0) & (F.size("heights") == 0)
    # Whole stretches as few pieces of 4^k cells: those that do not fit into a piece of the next width.
    widths = list(range(0, MOST.bit_length(), HALVINGS))
    whole = parts.where(plain & F.col("odd")).select("area", "glvl", "gy", "a", "b", F.explode(F.lit(widths)).alias("k"))
    none = F.array().cast("array<bigint>")
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)
    # Pieces of width k inside [a, b] are lo..hi, of which the wider ones hold 4 wlo .. 4 whi + 3.
    whole = whole.withColumns({"lo": F.expr("shiftright(a + shiftleft(1L, k) - 1, k)"), "hi": F.expr("shiftright(b + 1, k) - 1")})
    whole = whole.withColumns({"wlo": F.expr(f"shiftright(a + shiftleft(1L, k + {HALVINGS}) - 1, k + {HALVINGS})"), "whi": F.expr(f"shiftright(b + 1, k + {HALVINGS}) - 1")})
    pieces = F.when(F.col("wlo") > F.col("whi"), span(F.col("lo"), F.col("hi"))).otherwise(F.concat(
        span(F.col("lo"), F.col("wlo") * 2**HALVINGS - 1), span((F.col("whi") + 1) * 2**HALVINGS, F.col("hi"))))
    whole = whole.select("area", "glvl", "gy", "k", F.explode(pieces).alias("m"))
    whole = whole.groupBy("glvl", "gy", "k", "m").agg(F.count(F.lit(1)).alias("n"), F.min("area").alias("least"))
    used = placed.select(*cell).distinct().select("*", F.explode(F.lit(widths)).alias("k")).withColumn("m", F.expr("shiftright(gx, k)"))
    whole = used.hint("merge").join(whole, ["glvl", "gy", "k", "m"]).groupBy(*cell).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    partly = parts.where(~plain).select("area", "glvl", "gy", F.struct("area", "odd", "heights", "own").alias("e"), F.explode(F.sequence("a", "b")).alias("gx"))
    partly = partly.withColumn("row", F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy("area")) - 1) / LISTED))
    partly = partly.groupBy(*cell, "row").agg(F.collect_list("e").alias("list")).drop("row")
    rows = partly.unionByName(whole, allowMissingColumns=True)
    met = F.transform(F.filter("list", lambda p: _within(p, "px", "py")), lambda p: p["area"])
    hit = placed.join(rows, cell).select(pid, "n", "least", met.alias("met"))
    hit = hit.select(pid, F.coalesce("n", F.size("met")).cast("bigint").alias("n"), F.coalesce("least", F.array_min("met")).alias("area"))
    return hit.where("n > 0").groupBy(pid).agg(F.min("area").alias("area"), F.sum("n").alias("n_areas"))
