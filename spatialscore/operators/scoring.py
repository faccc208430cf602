"""Scores of predictive distributions per row and per group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions import draws as D
from ..functions.normal import INV_SQRT_PI, norm_cdf, norm_pdf, norm_ppf_const

SCORES = ["bias", "var", "mse", "rmse", "crps", "interval_score", "coverage", "width"]


def gaussian_crps(truth, mean, sd) -> Column:
    """A4: sd (z (2 cdf(z) - 1) + 2 pdf(z) - 1/sqrt(pi))."""
    y, m, s = as_col(truth), as_col(mean), as_col(sd)
    return standard_crps((y - m) / s, s)


def standard_crps(z, sd) -> Column:
    """A4 from the standardised error."""
    z, s = as_col(z), as_col(sd)
    return s * (z * (F.lit(2.0) * norm_cdf(z) - 1.0) + F.lit(2.0) * norm_pdf(z) - F.lit(INV_SQRT_PI))


def interval_score(truth, lower, upper, significance: float = 0.8) -> Column:
    """Width plus 2/alpha times the distance outside; edges are inside."""
    y, lo, hi = as_col(truth), as_col(lower), as_col(upper)
    f = F.lit(2.0 / (1.0 - significance))
    return (
        (hi - lo)
        + F.when(y < lo, f * (lo - y)).otherwise(F.lit(0.0))
        + F.when(y > hi, f * (y - hi)).otherwise(F.lit(0.0))
    )


def covered(truth, lower, upper, strict: bool = False) -> Column:
    """1 inside the interval; ``strict`` leaves the edges out."""
    y, lo, hi = as_col(truth), as_col(lower), as_col(upper)
    inside = ((lo < y) & (y < hi)) if strict else ((lo <= y) & (y <= hi))
    return inside.cast("double")


def ign(y, mean, sd) -> Column:
    """Logarithmic score z^2/2 + ln sd."""
    z = (as_col(y) - as_col(mean)) / as_col(sd)
    return z * z / 2.0 + F.ln(as_col(sd))


def pit(y, mean, sd) -> Column:
    """Probability integral transform."""
    return norm_cdf((as_col(y) - as_col(mean)) / as_col(sd))


def with_interval(df: DataFrame, est: str | None = None, sd: str | None = None, lower: str | None = None,
                  upper: str | None = None, draws: str | None = None, significance: float = 0.8) -> DataFrame:
    """Add ``_lower`` and ``_upper`` from given limits, draws, or mean and sd; swapped limits are put right."""
    alpha = 1.0 - significance
    if lower is not None and upper is not None:
        lo, hi = F.col(lower), F.col(upper)
    elif draws is not None:
        if "_sorted" not in df.columns:
            df = D.with_draw_stats(df, draws)
        lo = D.quantile_sorted("_sorted", alpha / 2.0)
        hi = D.quantile_sorted("_sorted", 1.0 - alpha / 2.0)
    elif est is not None and sd is not None:
        z = norm_ppf_const(1.0 - alpha / 2.0)
        lo, hi = F.col(est) - F.lit(z) * F.col(sd), F.col(est) + F.lit(z) * F.col(sd)
    else:
        raise ValueError("give lower and upper, draws, or est and sd")
    df = df.withColumns({"_lo0": lo, "_hi0": hi})
    return df.withColumns({"_lower": F.least("_lo0", "_hi0"), "_upper": F.greatest("_lo0", "_hi0")}).drop("_lo0", "_hi0")


def single_scores(df: DataFrame, truth: str, est: str | None = None, sd: str | None = None,
                  lower: str | None = None, upper: str | None = None, draws: str | None = None,
                  significance: float = 0.8, fuzzy: bool = False, sizes: str | None = None) -> DataFrame:
    """Per-row scores ``err, sq_err, abs_err, crps, interval_score, coverage, width``.

    The per-row variance needs the group's mean error, see :func:`centred_errors`.
    """
    base = df
    if draws is not None:
        base = D.with_draw_stats(base, draws)
        if est is None:
            base = base.withColumn("_est", D.mean_draws("_sorted"))
            est = "_est"
    base = with_interval(base, est, sd, lower, upper, draws, significance)
    y, err = F.col(truth), F.col(est) - F.col(truth)
    if draws is not None:
        crps = D.ensemble_crps("_sorted", y)
    elif sd is not None:
        base = base.withColumn("_z", (y - F.col(est)) / F.col(sd))
        crps = standard_crps("_z", sd)
    else:
        crps = F.lit(None).cast("double")
    if fuzzy:
        if draws is None:
            raise ValueError("fuzzy edges need draws")
        edge = D.fuzzy_edges("_sorted", truth, "_lower", "_upper", 1.0 - significance, sizes)
        cov, width = edge["coverage"], edge["width"]
        # The limits move only on rows where the truth is on an edge, so it stays inside or on them.
        alpha = 1.0 - significance
        iscore = (
            edge["width"]
            + F.when(y < F.col("_lower"), F.lit(2.0 / alpha) * (F.col("_lower") - y)).otherwise(F.lit(0.0))
            + F.when(y > F.col("_upper"), F.lit(2.0 / alpha) * (y - F.col("_upper"))).otherwise(F.lit(0.0))
        )
    else:
        cov = covered(y, "_lower", "_upper")
        width = F.col("_upper") - F.col("_lower")
        iscore = interval_score(y, "_lower", "_upper", significance)
    keep = [c for c in df.columns if c not in ("err", "sq_err", "abs_err", "crps", "interval_score", "coverage", "width")]
    return base.select(
        *keep, err.alias("err"), (err * err).alias("sq_err"), F.abs(err).alias("abs_err"), crps.alias("crps"),
        iscore.alias("interval_score"), cov.alias("coverage"), width.alias("width"),
    )


def score_aggregates() -> list[Column]:
    """A10: the eight scores of a group in one pass over the single scores."""
    return [
        F.avg("err").alias("bias"), F.var_pop("err").alias("var"), F.avg("sq_err").alias("mse"),
        F.sqrt(F.avg("sq_err")).alias("rmse"), F.avg("crps").alias("crps"),
        F.avg("interval_score").alias("interval_score"), F.avg("coverage").alias("coverage"),
        F.avg("width").alias("width"),
    ]


def score_agg(df: DataFrame, keys: list[str], **cols) -> DataFrame:
    """A10: per-group scores straight from predictions."""
    return single_scores(df, **cols).groupBy(*keys).agg(*score_aggregates())


def centred_errors(single: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``var``, the squared error around the group mean, by aggregate and join."""
    means = single.groupBy(*keys).agg(F.avg("err").alias("_mean_err"))
    d = F.col("err") - F.col("_mean_err")
    return single.join(means, keys).withColumn("var", d * d).drop("_mean_err")


def weighted_mse(df: DataFrame, keys: list[str], truth: str, est: str, weight: str) -> DataFrame:
    """A2: bias, variance and mean squared error with weights normalised to 1."""
    r, w = F.col(est) - F.col(truth), F.col(weight)
    agg = df.where(r.isNotNull() & w.isNotNull()).groupBy(*keys).agg(
        (F.sum(w * r) / F.sum(w)).alias("bias"), (F.sum(w * r * r) / F.sum(w)).alias("mse")
    )
    return agg.withColumn("var", F.col("mse") - F.col("bias") * F.col("bias"))


def share_within(df: DataFrame, keys: list[str], col: str, cut: float) -> DataFrame:
    """Share of rows with ``col <= cut``."""
    return df.groupBy(*keys).agg(F.avg((F.col(col) <= cut).cast("double")).alias("share"))


def quick_check(df: DataFrame, keys: list[str], truth: str, est: str, lower: str, upper: str,
                strict: bool = True) -> DataFrame:
    """Bias, root mean squared error and coverage."""
    r = F.col(est) - F.col(truth)
    return df.groupBy(*keys).agg(
        F.avg(r).alias("bias"), F.sqrt(F.avg(r * r)).alias("rmspe"),
        F.avg(covered(F.col(truth), lower, upper, strict)).alias("coverage"),
    )
