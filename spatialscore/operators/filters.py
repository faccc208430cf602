"""Row filters of the preparation steps (F1-F16); all are plain predicates that reach the scan."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col

# Fixed values of the quality flag: 0 best, 1 good, 2 bad, -1 not checked.
BAD, BEST = 2, 0


def quality_ok(flag, rule: str = "not_bad") -> Column:
    """``not_bad``, ``at_most_good`` (<= 1) or ``best``."""
    q = as_col(flag)
    return {"not_bad": q != BAD, "at_most_good": q <= 1, "best": q == BEST}[rule]


def in_box(x, y, xlim, ylim) -> Column:
    """inside a box, both ends included."""
    return as_col(x).between(*xlim) & as_col(y).between(*ylim)


def on_day_of_year(ts, day: int) -> Column:
    """F3."""
    return F.dayofyear(as_col(ts)) == day


def outside_boxes(df: DataFrame, x: str, y: str, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """rows in none of the rectangles (x0, x1, y0, y1)."""
    inside = reduce(lambda a, b: a | b, [in_box(x, y, (x0, x1), (y0, y1)) for x0, x1, y0, y1 in boxes])
    return df.where(~inside)


def split_role(masked, truth) -> Column:
    """train where the masked value is present, target where only the truth is."""
    m, t = as_col(masked), as_col(truth)
    return F.when(m.isNotNull(), F.lit("train")).when(t.isNotNull(), F.lit("target"))


def apply_mask(df: DataFrame, mask: DataFrame, on: list[str], value: str, mask_value: str) -> DataFrame:
    """the value becomes missing where the mask is missing."""
    m = mask.select(*on, F.col(mask_value).alias("_m"))
    return df.join(m, on, "left").withColumn(value, F.when(F.col("_m").isNotNull(), F.col(value))).drop("_m")


def from_sentinel(raw, sentinel: float = 0.0, scale: float = 1.0, offset: float = 0.0) -> Column:
    """F8: sentinel to NULL, then scale and offset."""
    return F.nullif(as_col(raw), F.lit(sentinel)) * F.lit(float(scale)) + F.lit(float(offset))


def drop_corner(df: DataFrame, x: str, y: str, x_above: float, y_above: float) -> DataFrame:
    """leave out the corner where both coordinates exceed their limits."""
    return df.where(~((F.col(x) > x_above) & (F.col(y) > y_above)))


def cell_window(df: DataFrame, ix0: int, nx: int, iy0: int, ny: int) -> DataFrame:
    """sub-rectangle of a grid by index."""
    return df.where(F.col("ix").between(ix0, ix0 + nx - 1) & F.col("iy").between(iy0, iy0 + ny - 1))


def nonzero_layers(weights: DataFrame, alpha: str = "alpha") -> DataFrame:
    """layers that have weight."""
    return weights.where(F.col(alpha) != 0)


def share_in_year(df: DataFrame, ts: str, year: int, keys: list[str] = ()) -> DataFrame:
    """F16: share of times inside a calendar year and their span."""
    return df.groupBy(*keys).agg(
        F.avg((F.year(ts) == year).cast("double")).alias("share"), F.min(ts).alias("first"), F.max(ts).alias("last"))
