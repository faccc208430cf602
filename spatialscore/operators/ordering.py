"""Ranks, running sums, quantiles and samples of groups that may hold most of the table.

A plain ordered window puts a whole group into one task. Here the order is first cut into value
ranges: ranges get their own partial counts and sums, a window over that small table gives every
range its offset, and only rows of one (group, range) are ordered together. A value that fills
several quantiles on its own is cut further by the tie-break column.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, default_buckets, written

# Fixed values of the portable integer hash: multipliers below 2^30, so that no product leaves 64 bits.
HASH_FOLD = 668265263
HASH_ROUNDS = (73244475, 295559667)
HASH_RANGE = 4294967296
HASH_MASK = HASH_RANGE - 1


def _hash_steps(x, seed: int, both, xor, right, times):
    """The hash over the operations of either engine: fold 64 bits to 32, mix the seed in, then multiply and shift."""
    mixed = ((seed & HASH_MASK) * 2654435761 + 40503) & HASH_MASK
    h = xor(both(x, HASH_MASK), xor(both(times(both(right(x, 32), HASH_MASK), HASH_FOLD), HASH_MASK), mixed))
    for m in HASH_ROUNDS:
        h = both(times(xor(h, right(h, 16)), m), HASH_MASK)
    return xor(h, right(h, 15))


def portable_hash(id_col: str | Column, seed: int = 0) -> Column:
    """Integer in [0, 2^32) that other engines can compute too, for ids of either sign.

    The seed is mixed in before the rounds, so each seed gives an order of its own.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return _hash_steps(c.cast("bigint"), seed, lambda a, b: a.bitwiseAND(F.lit(b)), lambda a, b: a.bitwiseXOR(lit(b)),
                       F.shiftright, lambda a, b: a * F.lit(b))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, which matters inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def portable_hash_once(x: Column, seed: int = 0) -> Column:
    """The same hash for use inside lambdas, every step worked out once."""
    mask = lambda c: c.bitwiseAND(F.lit(HASH_MASK))
    mixed = ((seed & HASH_MASK) * 2654435761 + 40503) & HASH_MASK
    fold = lambda x: mask(x).bitwiseXOR(mask(mask(F.shiftright(x, 32)) * F.lit(HASH_FOLD)).bitwiseXOR(F.lit(mixed)))
    turn = lambda h, m: mask(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(m))
    last = lambda h: h.bitwiseXOR(F.shiftright(h, 15))
    a, b = HASH_ROUNDS
    return let(x, lambda v: let(fold(v), lambda h: let(turn(h, a), lambda g: let(turn(g, b), last))))


def with_portable_hashes(df: DataFrame, values: dict[str, Column], seed: int = 0) -> DataFrame:
    """``df`` with the same hash of every value under its name; a projection for each step, so that none is worked out twice."""
    mask = lambda c: c.bitwiseAND(F.lit(HASH_MASK))
    mixed = ((seed & HASH_MASK) * 2654435761 + 40503) & HASH_MASK
    turn = lambda m: lambda h: mask(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(m))
    fold = lambda x: mask(x).bitwiseXOR(mask(mask(F.shiftright(x, 32)) * F.lit(HASH_FOLD)).bitwiseXOR(F.lit(mixed)))
    df = df.withColumns({n: c.cast("bigint") for n, c in values.items()})
    for step in (fold, *[turn(m) for m in HASH_ROUNDS], lambda h: h.bitwiseXOR(F.shiftright(h, 15))):
        df = df.withColumns({n: step(F.col(n)) for n in values})
    return df


def portable_hash_sql(id_expr: str, seed: int = 0) -> str:
    return _hash_steps(f"CAST({id_expr} AS BIGINT)", seed, lambda a, b: f"({a} & {b})", lambda a, b: f"xor({a}, CAST({b} AS BIGINT))",
                       lambda a, b: f"({a} >> {b})", lambda a, b: f"({a} * {b})")


def _bucketize(df: DataFrame, col: str, inner: list[float], out: str) -> DataFrame:
    splits = [-math.inf, *inner, math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def with_ranges(df: DataFrame, value: str, tie: str, n_buckets: int | None = None,
                hash_order: bool = False) -> DataFrame:
    """Add ``_b1`` (value range) and ``_b2`` (tie range inside a hot value)."""
    nb = n_buckets or default_buckets(df.sparkSession)
    if hash_order:
        # Hash values spread evenly over a known range: no look at the data is needed.
        return df.withColumn("_b1", F.floor(F.col(value) * nb / HASH_RANGE).cast("int")).withColumn("_b2", F.lit(0))
    key = df.select(F.col(value).cast("double").alias("_v"), F.col(tie).cast("double").alias("_t"))
    qs = key.approxQuantile("_v", [i / nb for i in range(1, nb)], 0.25 / nb)
    hot = sorted({a for a, b in zip(qs, qs[1:]) if a == b})
    inner = sorted({q for q in qs} | {math.nextafter(h, math.inf) for h in hot})
    out = _bucketize(df.withColumn("_v", F.col(value).cast("double")), "_v", inner, "_b1").drop("_v")
    if not hot:
        return out.withColumn("_b2", F.lit(0))
    tq = key.where(F.col("_v").isin(hot)).approxQuantile("_t", [i / nb for i in range(1, nb)], 0.25 / nb)
    out = _bucketize(out.withColumn("_t", F.col(tie).cast("double")), "_t", sorted(set(tq)), "_b2").drop("_t")
    return out.withColumn("_b2", F.when(F.col(value).cast("double").isin(hot), F.col("_b2")).otherwise(F.lit(0)))


def ordered(df: DataFrame, keys: list[str], value: str, tie: str, sums: dict[str, str] | None = None,
            n_buckets: int | None = None, hash_order: bool = False) -> DataFrame:
    """Add per-group order statistics without putting a group into one task.

    New columns: ``rn`` (1-based, by value then tie), ``rank`` (first rn of equal values), ``group_n``
    (group size) and, for each item of ``sums``, a running sum including the row.
    Rows whose ``value`` is NULL must be removed before.
    """
    sums = sums or {}
    if not hash_order:
        # The value order reads its input three times: work it out once.
        df = cut_lineage(df)
    ranged = with_ranges(df, value, tie, n_buckets, hash_order)
    part = ranged.groupBy(*keys, "_b1", "_b2").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()]
    )
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    order = by_key.orderBy("_b1", "_b2")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    before_b1 = by_key.orderBy("_b1").rangeBetween(Window.unboundedPreceding, -1)
    offs = part.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_b1").alias("_o1"), F.col("_b2").alias("_o2"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_c").over(before_b1), F.lit(0)).alias("_off1"),
        F.sum("_c").over(by_key).alias("group_n"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_s_{o}") for o in sums],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
                  + [F.col("_b1") == F.col("_o1"), F.col("_b2") == F.col("_o2")])
    joined = ranged.join(offs, cond)
    local = Window.partitionBy(*keys, "_b1", "_b2").orderBy(value, tie)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.when(F.col("_b2") > 0, F.col("_off1") + 1).otherwise(F.col("_off") + F.rank().over(
        Window.partitionBy(*keys, "_b1", "_b2").orderBy(value)))
    out = joined.select(
        *df.columns,
        (F.col("_off") + F.row_number().over(local)).alias("rn"),
        rank.alias("rank"),
        "group_n",
        *[(F.coalesce(F.col(f"_s_{o}"), F.lit(0)) + F.sum(src).over(upto)).alias(o) for o, src in sums.items()],
    )
    return out


#: Value ranges that a selection counts for each shuffle partition; it orders only those that hold a wanted rank.
FINER = 8


def select_ranks(df: DataFrame, keys: list[str], value: str, tie: str, ranks: Callable[[Column], Column],
                 n_buckets: int | None = None) -> DataFrame:
    """(keys, group_n, rn, value) of the rows whose 1-based rank by ``value`` is in ``ranks(group_n)``, an array of longs.

    Value ranges are counted first; only rows of ranges that hold a wanted rank are ordered, each range by itself. Of the
    input no more than the named columns is stored. Rows whose value is NULL have no rank.
    """
    # NULLs go after the value is stored: a filter in front of that would be pushed below what makes the value, and there
    # hold its whole expression once more, with every column that it uses several times worked out as often.
    narrow = written(df.select(*dict.fromkeys([*keys, value, tie]))).where(F.col(value).isNotNull())
    ranged = with_ranges(narrow, value, tie, n_buckets or FINER * default_buckets(df.sparkSession))
    part = ranged.groupBy(*keys, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_c"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    upto = by_key.orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumns({"_upto": F.sum("_c").over(upto), "group_n": F.sum("_c").over(by_key)})
    inside = F.filter(ranks(F.col("group_n")), lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_c")))
    found = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b1").alias("_o1"), F.col("_b2").alias("_o2"), "group_n",
                        (F.col("_upto") - F.col("_c")).alias("_off"), inside.alias("_wanted")).where(F.size("_wanted") > 0)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
                  + [F.col("_b1") == F.col("_o1"), F.col("_b2") == F.col("_o2")])
    place = F.col("_off") + F.row_number().over(Window.partitionBy(*keys, "_b1", "_b2").orderBy(value))
    rows = ranged.join(found, cond).withColumn("rn", place.cast("bigint"))
    return rows.where(F.array_contains(F.col("_wanted"), F.col("rn"))).select(*keys, "group_n", "rn", value)


def group_quantiles(df: DataFrame, keys: list[str], value: str, tie: str, probs: dict[str, float],
                    n_buckets: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group; only the two neighbouring order values are used."""
    def lower(n: Column, p: float) -> Column:
        return F.floor((n - 1) * F.lit(float(p)))

    def ranks(n: Column) -> Column:
        return F.array(*[r.cast("bigint") for p in probs.values() for r in (lower(n, p) + 1, F.least(lower(n, p) + 2, n))])

    o = select_ranks(df, keys, value, tie, ranks, n_buckets)
    aggs = []
    for name, p in probs.items():
        h, lo = (F.col("group_n") - 1) * F.lit(float(p)), lower(F.col("group_n"), p)
        a = F.max(F.when(F.col("rn") == lo + 1, F.col(value)))
        b = F.max(F.when(F.col("rn") == F.least(lo + 2, F.col("group_n")), F.col(value)))
        aggs.append((a + (b - a) * F.max(h - lo)).alias(name))
    return o.groupBy(*keys).agg(F.max("group_n").alias("n"), *aggs)


def hash_ordered(df: DataFrame, keys: list[str], id_col: str, seed: int = 0) -> DataFrame:
    """Repeatable random order per group: ``rn`` and ``group_n`` by portable hash, then id."""
    h = df.withColumn("_h", portable_hash(id_col, seed))
    return ordered(h, keys, "_h", id_col, hash_order=True).drop("_h", "rank")


def next_value(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with the next larger one (W9), by an equi join on the rank."""
    d = ordered(df.select(value).where(F.col(value).isNotNull()).distinct(), [], value, value).select(value, "rn")
    nxt = d.select(F.col(value).alias("next"), (F.col("rn") - 1).alias("rn"))
    return d.join(nxt, "rn", "left").drop("rn")
