"""Column factories: every value argument is a Column, every result is a Column."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def rounded(x, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(as_col(x), digits) + F.lit(0.0)
