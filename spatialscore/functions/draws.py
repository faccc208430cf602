"""Column factories over an array of posterior draws.

The array of one location is bounded by the number of draws, so it is handled inside the row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col
from .transforms import array_sum


def sorted_draws(draws) -> Column:
    return F.array_sort(F.filter(as_col(draws), lambda v: v.isNotNull()))


def quantile_sorted(sorted_arr, p: float) -> Column:
    """Linear-interpolation quantile of an array that is already sorted."""
    s = as_col(sorted_arr)
    n = F.size(s)
    h = (n - 1) * F.lit(float(p))
    lo = F.floor(h).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (h - lo))


def mean_draws(draws) -> Column:
    d = as_col(draws)
    return F.when(F.size(d) > 0, array_sum(d) / F.size(d))


def sd_draws(draws, mean) -> Column:
    """Sample sd around a mean column; a single draw gives NULL."""
    d, m = as_col(draws), as_col(mean)
    ss = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
    return F.when(F.size(d) > 1, F.sqrt(ss / (F.size(d) - 1)))


def with_draw_stats(df, draws: str, out: str = "_sorted"):
    """Sort the draws once per row; later expressions refer to the sorted column."""
    return df.withColumn(out, sorted_draws(draws))


def ensemble_crps(sorted_arr, truth) -> Column:
    """A5: mean |s_i - y| - sum (2 i - m - 1) s_(i) / m^2 over sorted draws."""
    s, y = as_col(sorted_arr), as_col(truth)
    m = F.size(s)
    spread = F.aggregate(
        F.transform(s, lambda v, i: (F.lit(2) * (i + 1) - m - 1) * v), F.lit(0.0), lambda acc, v: acc + v
    )
    dist = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.abs(v - y))
    return F.when((m > 0) & y.isNotNull(), dist / m - spread / (m * m))


def share(draws, pred) -> Column:
    d = as_col(draws)
    return F.size(F.filter(d, pred)) / F.size(d)


def min_gap(sorted_arr) -> Column:
    """Smallest gap between distinct sorted draws, NULL when they are all equal."""
    s = F.array_distinct(as_col(sorted_arr))
    gaps = F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda v, i: v - F.get(s, i))
    return F.when(F.size(s) > 1, F.array_min(gaps))


def fuzzy_edges(sorted_arr, truth, lower, upper, alpha: float, sizes=None) -> dict[str, Column]:
    """Rejection share at each edge and the coverage and width that follow from it.

    At an edge the share is (alpha/2 - P(draw beyond the edge)) / P(draw on the edge); rows off the
    edges are not changed.
    """
    y, lo, hi = as_col(truth), as_col(lower), as_col(upper)
    half = F.lit(alpha / 2.0)
    delta = F.lit(1.0) / as_col(sizes) if sizes is not None else min_gap(sorted_arr)
    p_lo = F.when(lo == y, (half - share(sorted_arr, lambda v: v < lo)) / share(sorted_arr, lambda v: v == lo))
    p_hi = F.when(hi == y, (half - share(sorted_arr, lambda v: v > hi)) / share(sorted_arr, lambda v: v == hi))
    inside = ((lo <= y) & (hi >= y)).cast("double")
    covered = F.least(inside, F.coalesce(F.lit(1.0) - p_lo, F.lit(1.0)), F.coalesce(F.lit(1.0) - p_hi, F.lit(1.0)))
    cut = lambda p: F.coalesce(delta * p, F.lit(0.0))
    return {
        "coverage": F.when(inside.isNotNull(), covered),
        "width": hi - lo - cut(p_lo) - cut(p_hi),
        "lower": lo + cut(p_lo),
        "upper": hi - cut(p_hi),
    }


def five_numbers(draws, sorted_arr, level: float = 0.8) -> Column:
    """Struct of mean, sd and lower, middle, upper quantile."""
    q = (1.0 - level) / 2.0
    m = mean_draws(sorted_arr)
    return F.struct(
        m.alias("est"),
        sd_draws(sorted_arr, m).alias("sd"),
        quantile_sorted(sorted_arr, q).alias("q_lower"),
        quantile_sorted(sorted_arr, 0.5).alias("q50"),
        quantile_sorted(sorted_arr, 1.0 - q).alias("q_upper"),
    )


def reduce_draws(draws, fn) -> Column:
    """Any Column -> Column function over the array of draws."""
    return fn(as_col(draws))
