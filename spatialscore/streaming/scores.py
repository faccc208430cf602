"""File streams: swath ingest and running binned scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_stream(spark: SparkSession, path: str, schema: StructType | str, rules: list[Column],
                  max_files: int | None = None, name_filter: str | None = None) -> DataFrame:
    """New Parquet files of a folder, filtered by quality, box and date rules as they arrive."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    df = reader.parquet(path)
    for r in rules:
        df = df.where(r)
    return df


def running_binned_scores(stream: DataFrame, ts: str, watermark: str, window: str, keys: list[str],
                          scores: list[str]) -> DataFrame:
    """R2: sums per (window, keys) as state; later files add to them until the watermark passes.

    Sums and counts merge, so the result equals the batch table over the same rows.
    """
    w = F.window(F.col(ts), window)
    agg = stream.withWatermark(ts, watermark).groupBy(w, *keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"sum_{s}") for s in scores])
    return agg.select(F.col("window.start").alias("day"), *keys, "n", *[(F.col(f"sum_{s}") / F.col("n")).alias(s) for s in scores])
