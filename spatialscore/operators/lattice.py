"""Knot lattices, compact basis entries and sparse products."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import wendland_inside

# Basis radius in knot spacings, and how layers refine.
OVERLAP = 2.5
REFINE = 2


@dataclass(frozen=True)
class Layer:
    """One lattice layer: knots at ``x0 + ix * width`` for 0 <= ix < nx, likewise in y."""

    layer: int
    x0: float
    y0: float
    width: float
    nx: int
    ny: int

    @property
    def theta(self) -> float:
        return OVERLAP * self.width


def lattice(xlim: tuple[float, float], ylim: tuple[float, float], nc: int = 5, n_buffer: int = 5,
            n_layer: int = 1) -> list[Layer]:
    """``nc`` knots along the longer side, a buffer all around, spacing halved per layer.

    Knots are centred in the shorter direction.
    """
    out = []
    xlen, ylen = xlim[1] - xlim[0], ylim[1] - ylim[0]
    for l in range(n_layer):
        n = nc if l == 0 else REFINE**l * (nc - 1) + 1
        width = max(xlen, ylen) / (n - 1)
        mx, my = (int(side / width + 1e-9) + 1 for side in (xlen, ylen))
        out.append(Layer(
            l + 1, (xlim[0] + xlim[1]) / 2 - (mx - 1) * width / 2 - n_buffer * width,
            (ylim[0] + ylim[1]) / 2 - (my - 1) * width / 2 - n_buffer * width,
            width, mx + 2 * n_buffer, my + 2 * n_buffer))
    return out


def lattice_sizes(boxes: DataFrame, nc, n_buffer: int = 5, n_layer: int = 3) -> DataFrame:
    """D23 for a table of boxes (``x_min, x_max, y_min, y_max``): knots and spacing per layer.

    ``nc`` is a column or number of knots along the longer side of the first layer.
    """
    nc = F.col(nc) if isinstance(nc, str) else F.lit(nc)
    t = boxes.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_layer))).alias("layer"))
    xlen, ylen = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    n = (F.pow(F.lit(float(REFINE)), F.col("layer") - 1) * (nc - 1) + 1).cast("bigint")
    t = t.withColumn("width", F.greatest(xlen, ylen) / (n - 1))
    knots = lambda side: F.floor(side / F.col("width") + 1e-9) + 1 + 2 * n_buffer
    return t.withColumns({"nx": knots(xlen), "ny": knots(ylen)}).withColumns(
        {"n_knots": F.col("nx") * F.col("ny"), "theta": F.col("width") * OVERLAP})


def smallest_lattice(boxes: DataFrame, keys: list[str], n_min: str, n_buffer: int = 5, n_layer: int = 3) -> DataFrame:
    """Smallest ``nc`` whose layers together have at least ``n_min`` knots, all candidates in one table.

    The first candidate gives the shorter side two knots. The first layer alone has at least
    (nc - 1)^2 * shorter / longer knots, which bounds the last candidate.
    """
    xlen, ylen = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    ratio = F.greatest(xlen, ylen) / F.least(xlen, ylen)
    first = F.ceil(F.lit(2.0) * ratio)
    last = first + F.ceil(F.sqrt(F.col(n_min) * ratio)) + 1
    cand = boxes.select("*", F.explode(F.sequence(first, last)).alias("nc"))
    total = lattice_sizes(cand, "nc", n_buffer, n_layer).groupBy(*keys, n_min, "nc").agg(F.sum("n_knots").alias("knots"))
    return total.groupBy(*keys, n_min).agg(
        F.min(F.when(F.col("knots") >= F.col(n_min), F.struct("nc", "knots"))).alias("_b")).select(
        *keys, n_min, F.col("_b.nc").alias("nc"), F.col("_b.knots").alias("knots"))


def basis_entries(points: DataFrame, layers: list[Layer], pid: str, x: str, y: str, carry: list[str] = ()) -> DataFrame:
    """Rows (point, layer, knot, a) of the sparse basis with compact support.

    Knots sit on a regular lattice, so the few knots near a point follow from its coordinates and no
    join is planned. ``knot`` is 0-based, x-major. ``carry`` names columns of the points that their entries keep: a join
    of the entries with a table of points would move or broadcast dozens of rows for each point.
    """
    keep = {c: f"_c_{c}" for c in carry}
    lay = F.array(*[F.struct(
        F.lit(l.layer).alias("layer"), F.lit(l.x0).alias("x0"), F.lit(l.y0).alias("y0"), F.lit(l.width).alias("w"),
        F.lit(l.nx).alias("nx"), F.lit(l.ny).alias("ny")) for l in layers])
    p = points.select(F.col(pid).alias("pid"), F.col(x).alias("px"), F.col(y).alias("py"), *[F.col(c).alias(n) for c, n in keep.items()]).select("*", F.inline(lay))
    lo = lambda c, c0: F.ceil((F.col(c) - F.col(c0)) / F.col("w") - OVERLAP).cast("int")
    hi = lambda c, c0: F.floor((F.col(c) - F.col(c0)) / F.col("w") + OVERLAP).cast("int")

    def axis(c, c0, n):
        a, b = F.greatest(lo(c, c0), F.lit(0)), F.least(hi(c, c0), F.col(n) - 1)
        return F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))

    p = p.select("*", axis("px", "x0", "nx").alias("kx")).select("*", axis("py", "y0", "ny").alias("ky"))
    dx = F.col("px") - (F.col("x0") + F.col("kx") * F.col("w"))
    dy = F.col("py") - (F.col("y0") + F.col("ky") * F.col("w"))
    p = p.select("pid", *keep.values(), "layer", "ny", "kx", "ky", (F.sqrt(dx * dx + dy * dy) / (F.col("w") * OVERLAP)).alias("s"))
    return p.where(F.col("s") < 1.0).select(
        F.col("pid").alias(pid), "layer", (F.col("kx").cast("bigint") * F.col("ny") + F.col("ky")).alias("knot"),
        wendland_inside("s").alias("a"), *[F.col(n).alias(c) for c, n in keep.items()])


def basis_row(layers: list[Layer], x: str, y: str) -> Column:
    """The entries of :func:`basis_entries` of a row's point as ARRAY<STRUCT<layer, knot, a>>."""
    def axis(c: str, c0: float, w: float, n: int) -> Column:
        t = (F.col(c) - F.lit(c0)) / F.lit(w)
        a, b = F.greatest(F.ceil(t - OVERLAP), F.lit(0)).cast("int"), F.least(F.floor(t + OVERLAP), F.lit(n - 1)).cast("int")
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    def entries(l: Layer) -> Column:
        def entry(kx: Column, ky: Column) -> Column:
            dx, dy = F.col(x) - (F.lit(l.x0) + kx * F.lit(l.width)), F.col(y) - (F.lit(l.y0) + ky * F.lit(l.width))
            return F.struct(F.lit(l.layer).alias("layer"), (kx.cast("long") * l.ny + ky).alias("knot"),
                            (F.sqrt(dx * dx + dy * dy) / F.lit(l.width * OVERLAP)).alias("s"))
        ky = axis(y, l.y0, l.width, l.ny)
        return F.flatten(F.transform(axis(x, l.x0, l.width, l.nx), lambda i: F.transform(ky, lambda j: entry(i, j))))

    inside = F.filter(F.concat(*[entries(l) for l in layers]), lambda e: e["s"] < 1.0)
    return F.transform(inside, lambda e: F.struct(e["layer"].alias("layer"), e["knot"].alias("knot"), wendland_inside(e["s"]).alias("a")))


def sparse_apply(entries: DataFrame, coef: DataFrame, pid: str, by_layer: bool = False, value: str = "c",
                 points: DataFrame | None = None) -> DataFrame:
    """Basis times coefficients, optionally per layer.

    A knot without a coefficient counts as 0. With ``points`` a point without entries has the value 0 too, in every
    layer of the entries if asked by layer.
    """
    keys = [pid, "layer"] if by_layer else [pid]
    term = F.col("a") * F.coalesce(value, F.lit(0.0))
    out = entries.join(coef, ["layer", "knot"], "left").groupBy(*keys).agg(F.sum(term).alias("value"))
    if points is None:
        return out
    every = points.select(pid).distinct()
    if by_layer:
        every = every.withColumn("layer", F.explode(entries.agg(F.collect_set("layer").alias("l")).scalar()))
    return every.join(out, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
