"""Ranking and comparing models."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import percent_difference


def rank_methods(df: DataFrame, method: str, metrics: list[str], targets: dict[str, float] | None = None) -> DataFrame:
    """Rank per metric (distance from the target where one is given) and the mean rank.

    ``df`` has one row per method; ties go to the first method by name. Losses that agree to nine decimals are
    ties, since their last bits depend on the order of summation.
    """
    targets = targets or {}
    loss = lambda m: F.abs(F.col(m) - F.lit(targets[m])) if m in targets else F.col(m)
    long = df.select(method, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(loss(m), 9).alias("loss")) for m in metrics])))
    w = Window.partitionBy("metric").orderBy(F.col("loss").asc_nulls_last(), F.col(method))
    ranked = long.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(method).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(f"rank_{m}") for m in metrics],
        F.avg("rank").alias("mean_rank"))


def rank_report(ranks: DataFrame, method: str) -> DataFrame:
    """By mean rank, regrouped by the first two letters of the method."""
    return ranks.orderBy(F.substring(method, 1, 2), "mean_rank", method)


def flag_best_worst(df: DataFrame, metrics: list[str], centres: dict[str, float] | None = None,
                    partition: list[str] = ()) -> DataFrame:
    """Best and worst per metric by distance from its centre; ties all flagged, NULL never."""
    centres = centres or {}
    dist = {m: F.abs(F.col(m) - F.lit(float(centres.get(m, 0.0)))) for m in metrics}
    lim = df.groupBy(*partition).agg(*[f(dist[m]).alias(f"_{n}_{m}") for m in metrics for n, f in (("b", F.min), ("w", F.max))])
    joined = df.join(lim, list(partition)) if partition else df.withColumns(
        {c: lim.select(c).scalar() for c in lim.columns})
    return joined.withColumns({
        **{f"{m}_best": F.coalesce(dist[m] == F.col(f"_b_{m}"), F.lit(False)) for m in metrics},
        **{f"{m}_worst": F.coalesce(dist[m] == F.col(f"_w_{m}"), F.lit(False)) for m in metrics},
    }).drop(*lim.drop(*partition).columns)


def pair_models(df: DataFrame, keys: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """One column per model on the same area or point."""
    return df.groupBy(*keys).pivot(model, models).agg(F.first(value))


def percent_diff(df: DataFrame, keys: list[str], model: str, value: str, ref: str) -> DataFrame:
    """Percent difference of each model from the chosen model at the same key."""
    r = df.where(F.col(model) == ref).select(*keys, F.col(value).alias("_ref"))
    return df.join(r, keys).withColumn("pct_diff", percent_difference(value, "_ref")).drop("_ref")


def arg_max(df: DataFrame, value: str, tie: str, keys: list[str] = ()) -> DataFrame:
    """Row with the largest value, the lowest ``tie`` on equal values."""
    cols = df.columns
    best = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(F.struct(F.col(value).alias("_v"), (-F.col(tie)).alias("_t"), F.struct(*cols).alias("row"))).alias("_b"))
    return best.select("_b.row.*")
