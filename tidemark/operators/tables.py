"""Tables between steps, in the folder that all executors share: written as Parquet and read back.

A written table cuts lineage, is there when executors are lost, and keeps rows in the partitions that they were numbered in.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset (single-machine tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send narrow rows to Python, so batches are bounded by rows alone: for the bound by bytes, Spark measures the
    whole batch again at each row, which takes longer than sending it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 0:
        spark.conf.set(key, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Steps:
    """The tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._count = spark, new_folder(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing lazy reads any more."""
        for df in tables:
            if path := getattr(df, "_path", None):
                delete(self.spark, path)

    def clear(self) -> None:
        """Delete all tables of the run: for results that don't read them any more."""
        delete(self.spark, self.root)
