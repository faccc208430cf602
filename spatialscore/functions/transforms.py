"""Scalar transforms of values, draws and names."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col
from .normal import norm_ppf_const


def logit(p) -> Column:
    """Log odds."""
    p = as_col(p)
    return F.ln(p / (F.lit(1.0) - p))


def expit(x) -> Column:
    """Inverse log odds, saturated beyond +-100."""
    x = as_col(x)
    return (
        F.when(x > 100.0, F.lit(1.0))
        .when(x < -100.0, F.lit(0.0))
        .otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))
    )


def shrunk_logit(p, shrink: float = 0.08) -> Column:
    """Log odds of a proportion pulled towards one half so that 0 and 1 stay finite."""
    p = as_col(p)
    return logit((p - 0.5) * F.lit(1.0 - 2.0 * shrink) + 0.5)


def shrunk_expit(x, shrink: float = 0.08) -> Column:
    """Inverse of :func:`shrunk_logit`."""
    return (expit(x) - 0.5) / F.lit(1.0 - 2.0 * shrink) + 0.5


def array_sum(arr) -> Column:
    return F.aggregate(as_col(arr), F.lit(0.0), lambda acc, v: acc + v)


def multi_logit(arr) -> Column:
    """Simplex (without its last part) to reals, log(x_i / (1 - sum x))."""
    arr = as_col(arr)
    rest = F.lit(1.0) - array_sum(arr)
    return F.transform(arr, lambda v: F.ln(v / rest))


def multi_expit(arr) -> Column:
    """Inverse, exp(z_i) / (1 + sum exp(z))."""
    arr = as_col(arr)
    ex = F.transform(arr, lambda v: F.exp(v))
    total = F.lit(1.0) + array_sum(ex)
    return F.transform(arr, lambda v: F.exp(v) / total)


def layer_weights(n_layer: int, nu) -> Column:
    """P5: weights 2^(-2 nu l) over layers, normalised; equal at nu = 0, first layer only at infinity."""
    nu = as_col(nu)
    first = F.array(*[F.lit(1.0 if l == 0 else 0.0) for l in range(n_layer)])
    raw = F.array(*[F.pow(F.lit(2.0), F.lit(-2.0 * (l + 1)) * nu) for l in range(n_layer)])
    total = reduce(lambda a, b: a + b, [F.pow(F.lit(2.0), F.lit(-2.0 * (l + 1)) * nu) for l in range(n_layer)])
    equal = F.array(*[F.lit(1.0 / n_layer)] * n_layer)
    return (
        F.when(nu <= math.exp(-100.0), equal)
        .when(nu > 300.0, first)
        .otherwise(F.transform(raw, lambda v: v / total))
    )


def clamp(x, lo: float, hi: float) -> Column:
    """Bring a value into a physical range, missing stays missing."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def clamp_array(arr, lo: float, hi: float) -> Column:
    """P6 for an array of draws."""
    return F.transform(as_col(arr), lambda v: F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def lognormal_moments(mu, var) -> Column:
    """Mean and variance of exp(N(mu, var)) as a struct."""
    mu, var = as_col(mu), as_col(var)
    mean = F.exp(mu + var / 2.0)
    return F.struct(mean.alias("mean"), ((F.exp(var) - 1.0) * mean * mean).alias("var"))


def log_scaled(x, unit: float) -> Column:
    """Log of a response in another unit."""
    return F.ln(as_col(x) / F.lit(float(unit)))


def polynomial(x, centre, scale) -> list[Column]:
    """Scaled linear and squared terms."""
    s = (as_col(x) - centre) / scale
    return [s, s * s]


def sd_from_interval(lo, hi, level: float = 0.95) -> Column:
    """Normal sd implied by a central interval."""
    return (as_col(hi) - as_col(lo)) / F.lit(2.0 * norm_ppf_const(0.5 + level / 2.0))


def interval_from_sd(mean, sd, level: float) -> tuple[Column, Column]:
    """Central normal interval."""
    z = norm_ppf_const(0.5 + level / 2.0)
    mean, sd = as_col(mean), as_col(sd)
    return mean - F.lit(z) * sd, mean + F.lit(z) * sd


def add_nugget_sd(sd, nugget_vars: list[float]) -> Column:
    """Predictive sd, the mean over nugget variances of sqrt(sd^2 + v)."""
    sd = as_col(sd)
    total = F.aggregate(F.lit([float(v) for v in nugget_vars]), F.lit(0.0), lambda t, v: t + F.sqrt(sd * sd + v))
    return total / F.lit(float(len(nugget_vars)))


def proportion(y, n) -> Column:
    """P20: y / n, missing when n is 0."""
    return as_col(y).cast("double") / F.nullif(as_col(n).cast("double"), F.lit(0.0))


def stratum_key(area, urban) -> Column:
    """Area name followed by U or R."""
    return F.concat(as_col(area), F.when(as_col(urban), F.lit("U")).otherwise(F.lit("R")))


def repair_names(name, spelling: dict[str, str]) -> Column:
    """Replace listed spelling variants, keep all other names."""
    name = as_col(name)
    out = F.lit(None).cast("string")
    for wrong, right in spelling.items():
        out = F.coalesce(out, F.when(name == wrong, F.lit(right)))
    return F.coalesce(out, name)


def substitute(name, rules: list[tuple[str, str]]) -> Column:
    """Apply regular-expression substitutions in order."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, as_col(name))


def percent_difference(x, y) -> Column:
    """100 (x - y) / y."""
    x, y = as_col(x), as_col(y)
    return F.lit(100.0) * (x - y) / y


def kappa_from_range(effective_range, width) -> Column:
    """Kappa of a layer with knot spacing ``width`` for a wanted effective range."""
    return F.lit(math.sqrt(8.0)) / as_col(effective_range) * as_col(width)


def range_from_kappa(kappa, width) -> Column:
    """Inverse of :func:`kappa_from_range`."""
    return F.lit(math.sqrt(8.0)) / as_col(kappa) * as_col(width)


def correlation(d, kind: str, range_, nu: float | None = None, weights=None) -> Column:
    """Correlation at distance ``d``; ``kind`` is exponential, matern or mixture.

    ``range_`` is the scale (for a mixture: a list of scales with ``weights``). Matern has the
    closed forms for smoothness 1/2, 3/2 and 5/2 and is integrated for any other.
    """
    d = as_col(d)
    if kind == "mixture":
        parts = [F.lit(float(w)) * correlation(d, "matern", r, nu or 0.5) for r, w in zip(range_, weights)]
        return reduce(lambda a, b: a + b, parts)
    s = d / as_col(range_)
    if kind == "exponential" or (kind == "matern" and nu == 0.5):
        return F.exp(-s)
    if kind == "matern" and nu == 1.5:
        u = F.lit(math.sqrt(3.0)) * s
        return (F.lit(1.0) + u) * F.exp(-u)
    if kind == "matern" and nu == 2.5:
        u = F.lit(math.sqrt(5.0)) * s
        return (F.lit(1.0) + u + u * u / 3.0) * F.exp(-u)
    if kind == "matern" and nu is not None and nu > 0:
        return integrated_matern(s, nu)
    raise ValueError(f"no correlation {kind!r} with smoothness {nu}")


#: Steps of the trapezoid rule; its error falls exponentially with their number.
MATERN_STEPS = 320


def integrated_matern(s, nu: float) -> Column:
    """Matern correlation of any smoothness at scaled distance ``s``.

    The Bessel function is the integral of exp(-u cosh t) cosh(nu t) over t > 0, taken up to where the first factor
    is below the smallest double.
    """
    u = F.lit(math.sqrt(2.0 * nu)) * as_col(s)
    h = F.acosh(F.lit(1.0) + F.lit(745.0) / u) / F.lit(float(MATERN_STEPS))
    term = lambda t: F.exp(F.lit(float(nu)) * t - u * F.cosh(t)) * (F.lit(1.0) + F.exp(F.lit(-2.0 * nu) * t)) / 2.0
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(MATERN_STEPS)), F.lit(0.0), lambda total, i: total + term(h * i))
    scale = F.exp(F.lit((1.0 - nu) * math.log(2.0) - math.lgamma(nu)) + F.lit(float(nu)) * F.ln(u))
    return F.when(u < 1e-10, 1.0).when(u > 700.0, 0.0).when(u.isNotNull(), scale * h * (term(F.lit(0.0)) / 2.0 + inner))


def standardised_residual(pred, truth, sd) -> Column:
    """(pred - truth) / sd."""
    return (as_col(pred) - as_col(truth)) / as_col(sd)


def bisquare(d, r) -> Column:
    """Compact weight (1 - (d/r)^2)^2 inside r, 0 outside."""
    d, r = as_col(d), as_col(r)
    u = F.lit(1.0) - (d / r) * (d / r)
    return F.when(d <= r, u * u).otherwise(F.lit(0.0))


def wendland(d, theta) -> Column:
    """Compact Wendland function of order 2 in two dimensions, 0 from ``theta`` on."""
    s = as_col(d) / as_col(theta)
    return F.when(s < 1.0, wendland_inside(s)).otherwise(F.lit(0.0))


def wendland_inside(s) -> Column:
    """The same for a scaled distance known to be below 1."""
    s = as_col(s)
    sq = (F.lit(1.0) - s) * (F.lit(1.0) - s)
    return sq * sq * sq * ((F.lit(35.0) * s + 18.0) * s + 3.0) / 3.0
