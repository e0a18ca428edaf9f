"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.tables import delete, shared_folder

_BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches that reach Python workers hold some 4 MB at most: the default bound is by rows, and a text can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < known <= _BATCH_BYTES:
        spark.conf.set(key, str(_BATCH_BYTES))


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that operators make inside the block, in this thread; those of other queries of the driver aren't among them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def clear(spark: SparkSession, folders: list[str]) -> None:
    """Delete ``folders``: for callers that have consumed or written every result made of them."""
    while folders:
        delete(spark, folders.pop())


class Scratch:
    """Tables of one run of one operator: written as Parquet and read back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        if (made := _MADE.get()) is not None:
            made.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing lazy reads any more."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                delete(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` hash partitions an integer that falls into it, so that ``n`` buckets get a task each."""
    from pyspark.sql import functions as F

    where = F.pmod(F.hash(F.col("key")), F.lit(n))
    for width in (16, 64, 256):
        keys = spark.range(width * n).select(F.col("id").cast("int").alias("key"))
        rows = keys.groupBy(where.alias("at")).agg(F.min("key").alias("key")).orderBy("at").collect()
        if len(rows) == n:
            break
    return [r["key"] for r in rows] if len(rows) == n else list(range(n))


def with_ids(rows: DataFrame, ids: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """The inner join of large ``rows`` with ``ids``: a broadcast if at most ``most`` rows of ids are counted, else dealt by ``on``."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on)


def without_ids(rows: DataFrame, ids: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """``rows`` whose ``on`` is not among ``ids``, joined as in ``with_ids``."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_anti")
