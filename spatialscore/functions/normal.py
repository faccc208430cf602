"""Standard normal density, distribution function and constant quantiles.

Spark has no ``erf``. The distribution function is the double-precision rational
approximation published by Hart (1968) in the form given by West (2005).
"""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

# Published coefficients, highest power first.
NUMERATOR = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
DENOMINATOR = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
TAIL_START = 7.07106781186547
TAIL_SCALE = 2.506628274631
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)


def norm_ppf_const(p: float) -> float:
    """Normal quantile of a constant, computed once on the driver."""
    return NormalDist().inv_cdf(p)


def norm_pdf(z) -> Column:
    z = as_col(z)
    return F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * z * z)


def _horner(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(z) -> Column:
    z = as_col(z)
    a = F.abs(z)
    e = F.exp(F.lit(-0.5) * a * a)
    body = e * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)
    frac = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    tail = e / frac / F.lit(TAIL_SCALE)
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < TAIL_START, body).otherwise(tail)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z > 0.0, F.lit(1.0) - upper).otherwise(upper)


def norm_cdf_sql(z: str) -> str:
    """The same expression as SQL text, for the checking queries."""
    def horner(coefs):
        out = f"{coefs[0]!r}::DOUBLE"
        for c in coefs[1:]:
            out = f"({out} * abs({z}) + {c!r}::DOUBLE)"
        return out

    e = f"exp(-0.5::DOUBLE * abs({z}) * abs({z}))"
    frac = f"(abs({z}) + 0.65::DOUBLE)"
    for k in ("4e0", "3e0", "2e0", "1e0"):
        frac = f"(abs({z}) + {k} / {frac})"
    upper = (
        f"(CASE WHEN abs({z}) > 37 THEN 0e0 WHEN abs({z}) < {TAIL_START!r}::DOUBLE "
        f"THEN {e} * {horner(NUMERATOR)} / {horner(DENOMINATOR)} "
        f"ELSE {e} / {frac} / {TAIL_SCALE!r}::DOUBLE END)"
    )
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) > 0 THEN 1e0 - {upper} ELSE {upper} END)"
