"""Connected components by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every node's neighbours, the larger ones or the smaller ones, with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; a root is the least node of its component.

    Loops and repeated edges do no harm; an edge with a null end is none. Each round is a partial aggregation and an
    equi join, however large a star is, and its edges are written to the shared folder.
    """
    held = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(held)
    while True:
        large = _stars(held, True)
        nxt = stored(_stars(large, False))
        now = mark(nxt)
        discard(held)
        held = nxt
        if now == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
