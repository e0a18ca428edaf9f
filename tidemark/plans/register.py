"""What the query modules share: the registry and rounding that Spark and DuckDB do alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.fixtures import load, with_adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *adapters: str, reads: str = ""):
    """Register the function as a query; it gets the tables and adapters named by ``reads``, and ``sql`` is its twin."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = reads.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[load(spark, sf_dir, n) for n in names])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_adapters(sql, *adapters) if adapters else sql
        return f

    return add


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    """The columns rounded; a negative zero becomes a plain one."""
    return [(F.round(c.cast("double"), digits) + F.lit(0.0)).alias(k) for k, c in columns.items()]
