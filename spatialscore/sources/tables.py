"""Reading observation, swath, lookup and prediction tables; writing results."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_observations(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed observation table; only the named columns are read."""
    return spark.read.schema(schema).parquet(path)


def read_swaths(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """All files of a folder (or one file) as one table with the name of the file a row came from."""
    df = spark.read.schema(schema).format(fmt).options(**options).load(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def expand_pixels(df: DataFrame, arrays: list[str], index: str = "pixel") -> DataFrame:
    """S3: one row per pixel of a scan line; columns that hold one value per line repeat."""
    rest = [c for c in df.columns if c not in arrays]
    z = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias(index, "_z"))
    return z.select(*rest, index, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def flatten_matrix(df: DataFrame, matrix: str, value: str = "value") -> DataFrame:
    """Nested array to long rows (ix, iy, value) with id ``ix * ny + iy``."""
    rest = [c for c in df.columns if c != matrix]
    rows = df.select(*rest, F.posexplode(matrix).alias("ix", "_row"))
    return rows.select(*rest, "ix", F.size("_row").alias("_ny"), F.posexplode("_row").alias("iy", value)).withColumn(
        "cell_id", F.col("ix") * F.col("_ny") + F.col("iy")).drop("_ny")


def read_csv(spark: SparkSession, path: str, schema: str, names: list[str] | None = None) -> DataFrame:
    """CSV with header and a stated schema, columns optionally renamed in order."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.toDF(*names) if names else df


def read_whitespace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table whose columns are parted by runs of blanks, with a header line; blank lines are passed over.

    A line with another number of fields stops the reading with an error that shows it.
    """
    fields = StructType.fromDDL(schema).fields
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("_p"))
    head = [f.name for f in fields]
    rows = lines.where(~F.concat_ws(" ", "_p").isin("", " ".join(head)))
    told = F.raise_error(F.concat(F.lit(f"expected {len(head)} fields: "), F.concat_ws(" ", "_p"))).cast("array<string>")
    rows = rows.select(F.when(F.size("_p") == len(head), F.col("_p")).otherwise(told).alias("_p"))
    return rows.select(*[F.get("_p", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def rekey(values: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Bring a method's output to the table's rows by key, never by position."""
    return keys.join(values, on, "left")


def write_results(df: DataFrame, path: str, keys: list[str] = ("model", "variation"), drop: list[str] = (),
                  mode: str = "overwrite") -> None:
    """Parquet partitioned by the keys, large payload columns left out.

    Only partitions present in ``df`` are replaced, so a run that continues keeps finished ones. The rebalance hint
    gathers the rows of a key and cuts a large key into as many tasks as its measured size asks for.
    """
    (df.drop(*drop).hint("rebalance", *[F.col(k) for k in keys])
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def unfinished(tasks: DataFrame, done: DataFrame | None, on: list[str]) -> DataFrame:
    """Tasks whose result is not written yet."""
    return tasks if done is None else tasks.join(done.select(*on).distinct(), on, "left_anti")


def union_files(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
