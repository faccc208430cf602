"""Right-closed bins and knots (rules 3 and 4 of the semantics list, P27, P28, B11)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col


def right_closed_bin(x, breaks: list[float]) -> Column:
    """Bin i holds (b_i, b_i+1]; the first also holds its left edge; outside is NULL."""
    x = as_col(x)
    below = reduce(lambda a, b: a + b, [F.when(x > F.lit(float(b)), 1).otherwise(0) for b in breaks])
    inside = (x >= F.lit(float(breaks[0]))) & (x <= F.lit(float(breaks[-1])))
    return F.when(inside, F.greatest(F.lit(1), below)).cast("int")


def even_bin(x, lo, width, n_bins, hi) -> Column:
    """Right-closed bin for breaks lo + i * width up to ``hi``, by arithmetic and one step of correction.

    The last break is exactly ``hi``, so rounding in lo + n * width cannot push the largest value out.
    """
    x, lo, width, hi = as_col(x), as_col(lo), as_col(width), as_col(hi)
    n_bins = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    guess = F.ceil((x - lo) / width)
    fixed = (
        F.when(x <= lo + (guess - 1) * width, guess - 1)
        .when(x > lo + guess * width, guess + 1)
        .otherwise(guess)
    )
    return F.when(x.between(lo, hi), F.least(F.greatest(F.lit(1).cast("bigint"), fixed), n_bins)).cast("int")


def even_midpoint(b, lo, width) -> Column:
    """Centre of an even bin: left break plus half the width."""
    return as_col(lo) + (as_col(b) - 1) * as_col(width) + as_col(width) / 2.0


def snap_to_knots(x, knots: list[float]) -> Column:
    """Nearest of the sorted knots; a tie goes to the upper one; ends are clamped."""
    x = as_col(x)
    knots = sorted(float(k) for k in knots)
    out = F.lit(knots[0])
    for lower, upper in zip(knots, knots[1:]):
        out = F.when(F.lit(upper) - x <= x - F.lit(lower), F.lit(upper)).otherwise(out)
    return F.when(x.isNotNull(), out)


def knot_cell(x, y, xlim, ylim, nrow: int = 30, ncol: int = 30) -> dict[str, Column]:
    """Cell of a knot grid (x-major id) and its bounds; the upper limit is inside by 1e-6."""
    x, y = as_col(x), as_col(y)
    x0, x1, y0, y1 = (as_col(v) for v in (*xlim, *ylim))
    wx, wy = (x1 + F.lit(1e-6) - x0) / ncol, (y1 + F.lit(1e-6) - y0) / nrow
    xi, yi = F.floor((x - x0) / wx) + 1, F.floor((y - y0) / wy) + 1
    return {
        "x_index": xi, "y_index": yi, "cell": (xi - 1) * nrow + yi,
        "x_low": x0 + (xi - 1) * wx, "x_high": x0 + xi * wx,
        "y_low": y0 + (yi - 1) * wy, "y_high": y0 + yi * wy,
    }
