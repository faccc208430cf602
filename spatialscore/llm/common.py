"""What the operators of this subpackage share: tables, stored intermediates and clash-free columns."""
from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as compressed Parquet in the shared folder and read it back.

    Cuts the lineage like checkpoint(), survives lost executors and takes less room than serialised rows.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` frame that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; NULL ids give NULL."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def heavy_join(rows: DataFrame, values: DataFrame, keys: str | list[str], n: str, how: str = "left", parts: int = 1000) -> DataFrame:
    """``rows`` joined (left or inner) with one row of ``values`` per key, whose column ``n`` says how many of ``rows`` have it.

    Keys with more than one in ``parts`` of the counted rows, fewer than ``parts`` in number whatever the data, are
    broadcast, so no task has to take all rows of a frequent key; the others are joined by shuffle. ``rows`` are read
    twice, ``values`` three times.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total = values.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) * parts > F.lit(total)
    few, many = F.broadcast(values.where(heavy)), values.where(~heavy)
    others = rows.join(few.select(*keys), keys, "left_anti") if how == "left" else rows
    return rows.join(few, keys).unionByName(others.join(many, keys, how))
