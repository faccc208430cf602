"""Session helpers: default settings for tests and the reliable checkpoint folder."""
from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spatialscore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spatialscore-ckpt-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; make one only in an unset local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spatialscore-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release_unused(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of rounds that are over: it acts when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def default_buckets(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of the driving table for each shuffle partition, and bytes up to which Spark may merge such partitions again.
ROWS_PER_TASK, MERGED_BYTES = 100_000, 16 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for steps that hold some rows for each of ``rows``: as set, more on large tables."""
    return max(default_buckets(spark), math.ceil(rows / ROWS_PER_TASK))


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries run inside are shuffled to :func:`tasks_for` partitions, so a task's memory does not grow with the table."""
    wanted = {"spark.sql.shuffle.partitions": str(tasks_for(spark, rows)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
