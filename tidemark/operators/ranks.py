"""Places in an order, and the values at places, of a whole table or of each key, without a task for a table, key or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import Steps


def shuffles(rows: DataFrame) -> int:
    return max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place", weight: str | None = None) -> DataFrame:
    """Add ``name``, the row's place from 0 in ``order`` among the rows of its ``keys``, or among all rows without keys.

    Rows are dealt by range of keys and order and written, so a large key spans many partitions, and equal values do so where
    later columns of ``order`` tell them apart. Each partition numbers its own; the counts of a key's earlier partitions, a row
    for each partition and key, are added. With ``weight`` a place is the sum of that column over the earlier rows.
    """
    steps = Steps(rows.sparkSession, "numbered")
    named = {f"_o{i}": c for i, c in enumerate(order)}
    by = [*keys, *named]
    dealt = rows.withColumns(named).repartitionByRange(shuffles(rows), *by)
    dealt = steps.save(dealt.withColumn("_part", F.spark_partition_id()))
    size = F.sum(weight) if weight else F.count("*")
    counts = dealt.groupBy(*keys, "_part").agg(size.alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), F.coalesce(earlier, F.lit(0)).alias("_start"))
    here = Window.partitionBy(*keys, "_part").orderBy(*named)
    local = F.coalesce(F.sum(weight).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(here) - 1
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_local", local)
    starts = starts if keys else F.broadcast(starts)  # without keys a row for each partition
    return placed.join(starts, same).select(*rows.columns, (F.col("_local") + F.col("_start")).alias(name))


def with_place(rows: DataFrame, by: str, ident: str, name: str = "place") -> DataFrame:
    """Add ``name``, the row's place from 0 in ascending order of ``by``, ties by ``ident``; NULLs come first."""
    return numbered(rows, [], [F.col(by), F.col(ident)], name)


_AT_ONCE = 100_000  # counted values that one task orders


class Counted:
    """How often each value of ``by`` occurs for each of ``keys``: one pass over ``rows``, from which any order statistics are read.

    Rows without a value don't count. Frequent values are one row here, so places are found in a table of distinct values: in
    one task if they are few, else numbered over ranges. Results are exact and the same either way. A row may stand for ``times``.
    """

    def __init__(self, rows: DataFrame, by: str, keys: list[str] | None = None, times: Column | None = None):
        self.keys = keys or []
        times = F.lit(1) if times is None else times
        named = rows.where(F.col(by).isNotNull()).select(*self.keys, F.col(by).cast("double").alias("_v"), times.cast("long").alias("_c"))
        self.steps = Steps(rows.sparkSession, "counted")
        self.rows = self.steps.save(named.groupBy(*self.keys, "_v").agg(F.sum("_c").alias("_c")))

    def placed(self, keys: list[str]) -> DataFrame:
        """Each key's distinct values ``_v`` with their count ``_c``, the first of their places ``_first``, and the key's ``n``."""
        counted = self.rows if keys == self.keys else self.rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
        if self.rows.count() <= _AT_ONCE:
            before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
            placed = counted.withColumn("_first", F.coalesce(before, F.lit(0)))
        else:
            placed = numbered(counted, keys, [F.col("_v")], "_first", weight="_c")
        sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"))
        if keys:
            sizes = sizes.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            placed = placed.join(sizes, same)
        else:
            placed = placed.crossJoin(F.broadcast(sizes))  # one row
        return placed.select(*keys, "_v", "_c", "_first", "n")

    def _around(self, keys: list[str], wanted: list[Column]) -> DataFrame:
        """As ``placed``, but of each key only its first range and those that hold a place of ``wanted``: values are dealt by range
        and summed there, and no other range is ordered."""
        counted = self.rows if keys == self.keys else self.rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
        dealt = self.steps.save(counted.repartitionByRange(shuffles(counted), *keys, "_v").withColumn("_part", F.spark_partition_id()))
        sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
        own = Window.partitionBy(*keys)
        ranges = sums.withColumns({"_start": F.coalesce(F.sum("_s").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_s").over(own)})
        holds = F.col("_start") == 0
        for place in wanted:
            holds |= (place >= F.col("_start")) & (place < F.col("_start") + F.col("_s"))
        ranges = ranges.where(holds).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), "_start", "n")
        same = F.col("_part") == F.col("_at")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        before = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
        return dealt.join(ranges, same).select(*keys, "_v", "_c", (F.col("_start") + F.coalesce(before, F.lit(0))).alias("_first"), "n")

    def at(self, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
        """For each key ``n`` and the values at the places ``wanted``, columns over ``n``; NULL for places outside."""
        at = lambda place: F.max(F.when((place >= F.col("_first")) & (place < F.col("_first") + F.col("_c")), F.col("_v")))
        placed = self.placed(keys) if self.rows.count() <= _AT_ONCE else self._around(keys, list(wanted.values()))
        return placed.groupBy(*keys).agg(F.max("n").alias("n"), *[at(place).alias(name) for name, place in wanted.items()])

    def quantiles(self, shares: list[float], keys: list[str] | None = None) -> DataFrame:
        """For each key ``n`` and ``q``, the quantiles, interpolated between the two nearest values. ``keys`` may be fewer."""
        keys = self.keys if keys is None else keys
        exact = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
        ends = {f"_{side}{i}": f(x).cast("long") for i, x in enumerate(exact) for side, f in (("low", F.floor), ("high", F.ceil))}
        between = lambda i, x: F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(
            F.col(f"_low{i}") * (F.ceil(x) - x) + F.col(f"_high{i}") * (x - F.floor(x))
        )
        return self.at(keys, ends).select(*keys, "n", F.array(*[between(i, x) for i, x in enumerate(exact)]).alias("q"))

    def clear(self) -> None:
        self.steps.clear()


def values_at(rows: DataFrame, by: str, places: list[int | Column]) -> list[float | None]:
    """The values of ``by`` at ``places``, from 0 or columns over ``n``, of its ascending order without NULLs; None for places outside."""
    counted = Counted(rows, by)
    try:
        found = counted.at([], {f"p{i}": p if isinstance(p, Column) else F.lit(p) for i, p in enumerate(places)}).first()
        return [found[f"p{i}"] for i in range(len(places))]
    finally:
        counted.clear()


def quantiles(rows: DataFrame, by: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of ``by``, interpolated between its two nearest values; None for a table without any."""
    counted = Counted(rows, by)
    try:
        return counted.quantiles(shares).first()["q"]
    finally:
        counted.clear()
