"""Registry of runnable queries: a Spark function and, where SQL can say the same, its checking SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: whole numbers as BIGINT, doubles rounded, so that two engines can be compared."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def checking_sql(views: str, body: str, rnd: str = "", ints: str = "", ctes: str = "", digits: int = 6) -> str:
    """The matching SQL: named views, then the body with the same rounding and casts as :func:`tidy`."""
    repl = [f"round({c}, {digits}) + 0e0 AS {c}" for c in rnd.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    star = f"* REPLACE ({', '.join(repl)})" if repl else "*"
    return with_views(views.split(), f"SELECT {star} FROM ({body}) AS checked", ctes)


def query(name: str, views: str = "", sql: str | None = None, rnd: str = "", ints: str = "", ctes: str = "",
          digits: int = 6):
    """Register a Spark function under ``name``; with ``sql`` also its checking query."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql is not None:
            CHECKS[name] = checking_sql(views, sql, rnd, ints, ctes, digits)
        return fn
    return register
