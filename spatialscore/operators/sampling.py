"""Repeatable samples, folds and splits (U1-U14, T5). Order is a portable integer hash, ties by id."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import hash_ordered


def stack(tables: list[DataFrame | None]) -> DataFrame:
    """Append tables by column name; a missing table is skipped."""
    return reduce(lambda a, b: a.unionByName(b), [t for t in tables if t is not None])


def random_order(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """T5: position of every row in a repeatable random order."""
    return hash_ordered(df, [], id_col, seed).drop("group_n").withColumnRenamed("rn", "position")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement."""
    return hash_ordered(df, [], id_col, seed).where(F.col("rn") <= n).drop("rn", "group_n")


def holdout(df: DataFrame, id_col: str, frac: float = 0.1, seed: int = 0) -> DataFrame:
    """Flag ``held_out`` for a rounded share of the rows."""
    o = hash_ordered(df, [], id_col, seed)
    return o.withColumn("held_out", F.col("rn") <= F.round(F.col("group_n") * F.lit(float(frac)))).drop("rn", "group_n")


def per_stratum(df: DataFrame, strata: list[str], n: int, id_col: str, exclude: DataFrame | None = None,
                seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum that are not in ``exclude``."""
    pool = df if exclude is None else df.join(exclude.select(id_col), id_col, "left_anti")
    return hash_ordered(pool, strata, id_col, seed).where(F.col("rn") <= n).drop("rn", "group_n")


def disjoint_samples(df: DataFrame, sizes: dict[str, tuple[Column | None, int]], id_col: str, seed: int = 0) -> DataFrame:
    """Several named samples, each from the rows its filter admits and no earlier sample took."""
    taken, parts = None, []
    for i, (name, (rule, n)) in enumerate(sizes.items()):
        pool = df if rule is None else df.where(rule)
        s = per_stratum(pool, [], n, id_col, taken, seed + i).withColumn("sample", F.lit(name))
        parts.append(s)
        taken = stack([p.select(id_col) for p in parts])
    return stack(parts)


def stratified_folds(df: DataFrame, strata: list[str], id_col: str, k: int = 8, seed: int = 123) -> DataFrame:
    """Fold 1..k; inside a stratum sizes differ by at most 1 and the last folds get the extra rows."""
    o = hash_ordered(df, strata, id_col, seed)
    base, extra = F.floor(F.col("group_n") / k), F.col("group_n") % k
    plain = (F.lit(k) - extra) * base        # rows of the folds without an extra row
    i = F.col("rn") - 1
    fold = F.when(i < plain, F.floor(i / F.nullif(base, F.lit(0)))).otherwise(
        F.lit(k) - extra + F.floor((i - plain) / (base + 1)))
    return o.withColumn("fold", (fold + 1).cast("int")).drop("rn", "group_n")


def region_folds(df: DataFrame, region: str) -> DataFrame:
    """One fold per region."""
    return df.withColumn("fold", F.col(region))


def equal_parts(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """U8: subset 0..k-1 of equal size in random order, the last takes the remainder."""
    o = hash_ordered(df, [], id_col, seed)
    size = F.greatest(F.floor(F.col("group_n") / k), F.lit(1).cast("bigint"))
    return o.withColumn("subset", F.least(F.floor((F.col("rn") - 1) / size), F.lit(k - 1)).cast("int")).drop("rn", "group_n")


def remaining(df: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """Everything that was not taken."""
    return df.join(taken, on, "left_anti")


def split_audit(df: DataFrame, train: Column, cv: Column, missing: Column) -> DataFrame:
    """Code 1 train, +2 cross-validation, +4 missing, and the rows per code."""
    code = train.cast("int") + cv.cast("int") * 2 + missing.cast("int") * 4
    return df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def task_grid(axes: dict[str, list], base: DataFrame, keep: Column | None = None) -> DataFrame:
    """Every row of ``base`` with all combinations of short parameter lists, invalid ones removed."""
    out = base
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out if keep is None else out.where(keep)
