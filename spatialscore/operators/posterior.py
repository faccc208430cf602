"""Summaries and areal aggregation of posterior draws."""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws as D
from ..session import cut_lineage
from .ordering import HASH_RANGE, group_quantiles, let, ordered, portable_hash, portable_hash_once, portable_hash_sql


def summarise_draws(df: DataFrame, draws: str, level: float = 0.8, prefix: str = "") -> DataFrame:
    """Mean, sd and lower, middle, upper quantile of every row's draws."""
    q = (1.0 - level) / 2.0
    s = D.with_draw_stats(df, draws).withColumn("_m", D.mean_draws("_sorted"))
    return s.select(
        *df.columns, F.col("_m").alias(f"{prefix}est"), D.sd_draws("_sorted", "_m").alias(f"{prefix}sd"),
        D.quantile_sorted("_sorted", q).alias(f"{prefix}q10"), D.quantile_sorted("_sorted", 0.5).alias(f"{prefix}q50"),
        D.quantile_sorted("_sorted", 1.0 - q).alias(f"{prefix}q90"))


def summarise_parameters(long: DataFrame, keys: list[str], value: str, tie: str, level: float = 0.8) -> DataFrame:
    """Five-tuple per hyperparameter from long rows (parameter, draw, value)."""
    q = (1.0 - level) / 2.0
    moments = long.groupBy(*keys).agg(F.avg(value).alias("est"), F.stddev_samp(value).alias("sd"))
    quants = group_quantiles(long, keys, value, tie, {"q_lower": q, "q50": 0.5, "q_upper": 1.0 - q}).drop("n")
    return moments.join(quants, keys)


def derive_params(df: DataFrame, n_layer: int, spatial_var: str = "spatial_var", cluster_var: str = "cluster_var",
                  alpha: str = "alpha") -> DataFrame:
    """D3: total variance, the sds, and the last layer weight as one minus the others."""
    others = sum((F.col(f"{alpha}{i}") for i in range(1, n_layer)), F.lit(0.0))
    total = F.col(spatial_var) + F.col(cluster_var)
    return df.withColumns({
        "total_var": total, "total_sd": F.sqrt(total), "spatial_sd": F.sqrt(spatial_var),
        "cluster_sd": F.sqrt(cluster_var), f"{alpha}{n_layer}": F.lit(1.0) - others})


def areal_draws(df: DataFrame, area: list[str], weight: str, draws: str, with_weight: bool = False) -> DataFrame:
    """Weighted mean of every draw over each area; ``with_weight`` adds the area's weight under its name, and the
    result can then be aggregated further like the rows themselves.

    The aggregate works on whole vectors, so draws are never exploded and the shuffle carries one
    vector per area and map task. Rows without draws count as rows without weight; an area of no weight
    has NULL draws.
    """
    v = df.where((F.col(weight) > 0) & F.col(draws).isNotNull()).select(*area, F.col(weight).cast("double").alias("_w"),
                                           array_to_vector(draws).alias("_v"))
    means = v.groupBy(*area).agg(Summarizer.metrics("mean").summary(F.col("_v"), F.col("_w")).alias("_s"), F.sum("_w").alias("_w")).select(
        *[F.col(c).alias(f"_k_{c}") for c in area], vector_to_array("_s.mean").alias("draws"), F.col("_w").alias(f"_weight_{weight}"))
    every = df.select(*area).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in area])
    return every.join(means, same, "left").select(*area, "draws", *([F.col(f"_weight_{weight}").alias(weight)] if with_weight else []))


def aggregate_levels(df: DataFrame, levels: dict[str, list[str]], weight: str, draws: str, level: float = 0.8,
                     pixel_key: str | None = None) -> DataFrame:
    """One summary row per area of every level, with a ``level`` column and the area as text.

    The draws of the pixels are aggregated once, to the finest areas that the keys of all levels make together; these
    means and weights, stored in the checkpoint folder, are what every level adds up. Levels should nest, or nearly so.
    """
    finest = cut_lineage(areal_draws(df, list(dict.fromkeys(k for keys in levels.values() for k in keys)), weight, draws, with_weight=True))
    parts = []
    if pixel_key is not None:
        parts.append(summarise_draws(df, draws, level).select(
            F.lit("pixel").alias("level"), F.col(pixel_key).cast("string").alias("area"), "est", "sd", "q10", "q50", "q90"))
    for name, keys in levels.items():
        a = summarise_draws(areal_draws(finest, keys, weight, "draws"), "draws", level)
        parts.append(a.select(F.lit(name).alias("level"), F.concat_ws("/", *keys).alias("area"),
                              "est", "sd", "q10", "q50", "q90"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def curve_summary(long: DataFrame, keys: list[str], value: str, tie: str, level: float = 0.8) -> DataFrame:
    """Mean and band per distance over draws of a covariance or correlation curve."""
    q = (1.0 - level) / 2.0
    m = long.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return m.join(group_quantiles(long, keys, value, tie, {"lower": q, "upper": 1.0 - q}).drop("n"), keys)


def effective_range(df: DataFrame, keys: list[str], d: str, cor: str, cut: float = 0.1) -> DataFrame:
    """First distance with correlation at or below ``cut``, else the largest and a flag."""
    first = F.min(F.when(F.col(cor) <= cut, F.col(d)))
    return df.groupBy(*keys).agg(F.coalesce(first, F.max(d)).alias("effective_range"),
                                 first.isNull().alias("beyond"))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, tie: str,
                       probs: dict[str, float]) -> DataFrame:
    """First pooled atom whose cumulative weight reaches each probability."""
    o = ordered(df.where(F.col(value).isNotNull()), keys, value, tie, sums={"_cum": weight})
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(weight).alias("_total"))
    o = o.join(total, keys)
    # Rounding in sums of weights must not push an atom past its probability.
    share = F.col("_cum") / F.col("_total") + F.lit(1e-12)
    return o.groupBy(*keys).agg(*[F.min(F.when(share >= p, F.col(value))).alias(n) for n, p in probs.items()])


def weighted_quantiles_of(df: DataFrame, keys: list[str], atoms: str, probs: dict[str, float]) -> DataFrame:
    """D17 where a row holds all its atoms, as ARRAY<STRUCT<value, tie, weight>>: (keys, quantiles) of every row with an atom."""
    plain = df.select(*keys, F.array_sort(F.filter(atoms, lambda a: a["value"].isNotNull())).alias("_a")).where(F.size("_a") > 0)
    summed = plain.select("*", F.aggregate("_a", F.lit(0.0), lambda acc, a: acc + a["weight"]).alias("_total"))

    def step(acc: Column, a: Column) -> Column:
        def with_sum(cum: Column) -> Column:
            # Rounding in sums of weights must not push an atom past its probability.
            share = cum / F.col("_total") + F.lit(1e-12)
            return F.struct(cum.alias("cum"), *[F.coalesce(acc[n], F.when(share >= p, a["value"])).alias(n) for n, p in probs.items()])
        return let(acc["cum"] + a["weight"], with_sum)

    start = F.struct(F.lit(0.0).alias("cum"), *[F.lit(None).cast("double").alias(n) for n in probs])
    return summed.select(*keys, F.aggregate("_a", start, step).alias("_q")).select(*keys, *[F.col(f"_q.{n}").alias(n) for n in probs])


def simulation_se(df: DataFrame, draws: str, sigma: float) -> DataFrame:
    """sqrt(sample variance of the draws + sigma^2)."""
    s = df.withColumn("_m", D.mean_draws(draws))
    sd = D.sd_draws(draws, "_m")
    return s.withColumn("se", F.sqrt(sd * sd + F.lit(float(sigma) ** 2))).drop("_m")


def effect_curve(params: DataFrame, knots: DataFrame, keys: list[str], walk: str, slope: str, draw: str,
                 level: float = 0.8, percent: bool = False) -> DataFrame:
    """Random-walk value plus slope times knot per draw, then mean and interval per knot.

    ``params`` has one row per (draw, knot) with the walk value and the draw's slope; ``knots`` maps
    the knot to its value.
    """
    eff = params.join(knots, "knot").withColumn("effect", F.col(walk) + F.col(slope) * F.col("knot_value"))
    if percent:
        eff = eff.withColumn("effect", F.lit(100.0) * (F.exp("effect") - 1.0))
    return curve_summary(eff, [*keys, "knot"], "effect", draw, level)


#: Tries of the rejection sampling; all fail with a probability below 1e-20.
TRIES = 16
#: Purposes of a uniform: a normal value's two, the test of a try, the power for small shapes, and the second gamma of a beta.
NORMAL_A, NORMAL_B, TEST, POWER, SECOND = 1, 2, 3, 4, 8


def add_noise(df: DataFrame, id_col: str, draws: str, family: str, size: str | None = None, var: str | None = None,
              rho: float | None = None, dispersion: float | None = None, seed: int = 0) -> DataFrame:
    """Observation noise on every draw, as native expressions.

    All randomness follows from the row's id, the seed, the draw and a counter, hashed in rounds of 64 bits, so results
    do not depend on partitioning and no two rows share their noise. Families: binomial (needs ``size``) counts uniforms
    below the draw; gaussian (``var``, one value or one per draw) turns two into a normal value; gamma (``dispersion``) and
    beta (``rho``, two gammas) take the first of ``TRIES`` tries that is accepted. A NULL draw, size or variance gives NULL,
    a size of 0 NaN.
    """
    if (family, {"binomial": size, "gaussian": var, "beta": rho, "gamma": dispersion}.get(family, 0)) == (family, None):
        raise ValueError(f"{family} noise lacks its parameter")
    keyed = df.withColumns({"_h1": portable_hash(id_col, seed), "_h2": portable_hash(id_col, seed + SECOND_LANE)})
    state = lambda i: draw_state("_h1", "_h2", i + 1)
    if family == "binomial":
        n = F.col(size).cast("int")
        trials = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def hits(p: Column, i: Column) -> Column:
            count = F.aggregate(F.col("_trials"), F.struct(F.lit(0).alias("n"), state(i).alias("s")), lambda acc, t: F.struct(
                (acc["n"] + (uniform(acc["s"], t) < p).cast("int")).alias("n"), acc["s"].alias("s")), lambda acc: acc["n"])
            return F.when(n > 0, F.when(p.isNotNull(), count / n.cast("double"))).when(n.isNotNull(), F.lit(float("nan")))
        keyed, noise = keyed.withColumn("_trials", trials), F.transform(F.col(draws), hits)
    elif family == "gaussian":
        per_draw = isinstance(df.schema[var].dataType, T.ArrayType)
        noise = F.transform(F.col(draws), lambda v, i: v + let(state(i), lambda s: normal(s, F.lit(0))) * F.sqrt(F.get(F.col(var), i) if per_draw else F.col(var)))
    elif family == "gamma":
        # The shape is the same for all draws, since their scale grows with them.
        noise = F.transform(F.col(draws), lambda d, i: gamma(state(i), F.lit(1.0 / dispersion), 0) * d * F.lit(dispersion))
    elif family == "beta":
        total, least = 1.0 / rho - 1.0, F.lit(1e-12)

        def ratio(d: Column, i: Column) -> Column:
            two = F.struct(gamma(state(i), F.greatest(d * F.lit(total), least), 0).alias("a"),
                           gamma(state(i), F.greatest((1.0 - d) * F.lit(total), least), SECOND).alias("b"))
            return F.when(d.isNotNull(), let(two, lambda g: g["a"] / (g["a"] + g["b"])))
        noise = F.transform(F.col(draws), ratio)
    else:
        raise ValueError(f"unknown noise family {family!r}")
    return keyed.withColumn("noisy", noise).drop("_h1", "_h2", "_trials")


#: Difference of the seeds of the two halves of the hashed state.
SECOND_LANE = 977


def _next(half, counter, seed: int):
    """One half of the state after a counter of up to 30 bits; a half has 32 bits."""
    return portable_hash_once(half * F.lit(1 << 30) + counter.cast("bigint"), seed)


def draw_state(h1: str, h2: str, draw: Column) -> Column:
    """64 bits of state, in two halves, of a row and one of its draws."""
    return F.struct(_next(F.col(h1), draw, 1).alias("a"), _next(F.col(h2), draw, 2).alias("b"))


def uniform(state: Column, counter: Column) -> Column:
    """Repeatable uniform in (0, 1) for a counter."""
    mixed = _next(state["a"], counter, 3).bitwiseXOR(_next(state["b"], counter, 4))
    return (mixed + 0.5) / F.lit(float(HASH_RANGE))


def normal(state: Column, base: Column) -> Column:
    """Standard normal value from two uniforms; ``base`` is added to their counters."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(state, base + NORMAL_A))) * F.cos(F.lit(2.0 * np.pi) * uniform(state, base + NORMAL_B))


def gamma(state: Column, shape: Column, purpose: int) -> Column:
    """Gamma value of a shape and scale 1: a cubed normal accepted against a uniform, and a power of one for shapes below 1."""
    def chosen(p: Column) -> Column:
        def one_try(acc: Column, t: Column) -> Column:
            base = t * 16 + purpose

            def accepted(g: Column) -> Column:
                fits = F.ln(uniform(p["s"], base + TEST)) < 0.5 * g["x"] * g["x"] + p["d"] - p["d"] * g["cube"] + p["d"] * F.ln(g["cube"])
                return F.when((g["cube"] > 0) & fits, p["d"] * g["cube"])

            def cubed(x: Column) -> Column:
                root = 1.0 + x / F.sqrt(9.0 * p["d"])
                return F.struct(x.alias("x"), (root * root * root).alias("cube"))
            return F.coalesce(acc, let(normal(p["s"], base), lambda x: let(cubed(x), accepted)))
        first = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), one_try), p["d"])
        return first * F.when(p["k"] < 1, F.pow(uniform(p["s"], F.lit(POWER + purpose)), 1.0 / p["k"])).otherwise(F.lit(1.0))
    return let(F.struct(state.alias("s"), shape.alias("k"), (F.when(shape < 1, shape + 1.0).otherwise(shape) - 1.0 / 3.0).alias("d")), chosen)


# --- the same in SQL -------------------------------------------------------------------------------

def _next_sql(half: str, counter: str, seed: int) -> str:
    return portable_hash_sql(f"{half} * {1 << 30} + CAST({counter} AS BIGINT)", seed)


def noise_ctes(rows: str, id_expr: str, seed: int) -> str:
    """CTE ``states``: ``rows`` (its draws as list ``p``) with one row (i, v, a, b) for each draw and the halves of its state."""
    h1, h2 = (portable_hash_sql(id_expr, seed + lane) for lane in (0, SECOND_LANE))
    return f"""lanes AS (SELECT *, {h1} AS h1, {h2} AS h2, unnest(range(1, len(p) + 1)) AS i FROM ({rows})),
    states AS (SELECT *, p[i] AS v, {_next_sql('h1', 'i', 1)} AS a, {_next_sql('h2', 'i', 2)} AS b FROM lanes)"""


def normal_sql(base: str) -> str:
    return f"sqrt(-2e0 * ln({uniform_sql('a', 'b', f'({base} + {NORMAL_A})')})) * cos({2 * np.pi!r}::DOUBLE * {uniform_sql('a', 'b', f'({base} + {NORMAL_B})')})"


def gamma_ctes(name: str, shape: str, purpose: int) -> str:
    """CTE ``name``: a gamma value ``g`` for every row of ``states``, from its first accepted try."""
    base = f"(t * 16 + {purpose})"
    return f"""{name}_k AS (SELECT *, {shape} AS k FROM states),
    {name}_d AS (SELECT *, CASE WHEN k < 1 THEN k + 1 ELSE k END - 1e0 / 3e0 AS d FROM {name}_k),
    {name}_x AS (SELECT *, {normal_sql(base)} AS x FROM {name}_d, range(1, {TRIES + 1}) AS r(t)),
    {name}_c AS (SELECT *, (1e0 + x / sqrt(9e0 * d)) * (1e0 + x / sqrt(9e0 * d)) * (1e0 + x / sqrt(9e0 * d)) AS cube, {uniform_sql('a', 'b', f'({base} + {TEST})')} AS u FROM {name}_x),
    {name}_t AS (SELECT vec_id, i, min_by(d * cube, t) AS first FROM {name}_c
      WHERE cube > 0 AND ln(u) < 0.5::DOUBLE * x * x + d - d * cube + d * ln(CASE WHEN cube > 0 THEN cube ELSE 1e0 END) GROUP BY vec_id, i),
    {name} AS (SELECT s.*, coalesce(first, d) * CASE WHEN k < 1 THEN pow({uniform_sql('a', 'b', str(POWER + purpose))}, 1e0 / k) ELSE 1e0 END AS g
      FROM {name}_d s LEFT JOIN {name}_t USING (vec_id, i))"""


def uniform_sql(a: str, b: str, counter: str) -> str:
    return f"(xor({_next_sql(a, counter, 3)}, {_next_sql(b, counter, 4)}) + 0.5::DOUBLE) / {float(HASH_RANGE)!r}::DOUBLE"
