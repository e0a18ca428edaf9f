"""Row numbers within few large keys, without one task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, partitions


def ranked(df: DataFrame, key: str, order: list[Column], scratch: Scratch, name: str = "rank", weight: str | None = None) -> DataFrame:
    """Add ``name``, the row's number from 1 among the rows of its ``key`` in ``order``; with ``weight`` the sum of it up to the row.

    Rows are dealt by range of (key, order), so a large key spans many partitions. Each numbers its own rows; the counts of
    the earlier partitions, one row for each partition and key, are added. Exact ties are numbered in any order.
    """
    numbered = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *numbered).repartitionByRange(partitions(df.sparkSession), key, *names)
    dealt = scratch.save(dealt.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_part").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(key, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    here = Window.partitionBy(key, "_part").orderBy(*names)
    local = F.sum(weight).over(here.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(here)
    return (
        dealt.withColumn("_local", local)
        .join(before, [key, "_part"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before", *names)
    )
