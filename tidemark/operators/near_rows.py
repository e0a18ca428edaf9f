"""The nearest rows of each row by a few features: an exact join over a partition of space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import Steps

_TILE = 1024  # rows whose distances to a cell are held at once
_SAMPLE = 200_000  # points whose values place the cuts
_MOST_CELLS = 1 << 16


@dataclass
class Cells:
    """A tree of cuts at medians of a sample: node i has children 2i + 1 and 2i + 2; a leaf's cell is its place among the leaves.

    Cuts steer the work only. ``low`` and ``high``, once set, are the corners of each cell's points.
    """

    axis: np.ndarray
    cut: np.ndarray
    depth: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Cells:
        inner = (1 << depth) - 1
        axis, cut, parts = np.zeros(inner, np.int64), np.full(inner, np.inf), [sample]
        for node in range(inner):
            mine = parts[node]
            if len(mine):
                axis[node] = np.argmax(mine.max(axis=0) - mine.min(axis=0))
                cut[node] = np.median(mine[:, axis[node]])
            left = mine[:, axis[node]] < cut[node]
            parts += [mine[left], mine[~left]]
            parts[node] = mine[:0]
        return Cells(axis, cut, depth)

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's place and a cell that may hold points within the point's radius, its border included."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            off = points[at, self.axis[node]] - self.cut[node]
            left, right = off < radius[at] + _NEAR, off >= -radius[at] - _NEAR
            at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        cell = node - len(self.axis)
        gap = np.maximum(np.maximum(self.low[cell] - points[at], points[at] - self.high[cell]), 0.0)
        close = (gap**2).sum(axis=1) <= radius[at] ** 2 + _NEAR
        return at[close], cell[close]


_NEAR = 1e-9  # more than rounding moves a bound
_FOUND = "point long, near long, distance double"


def _nearest(asked: pd.DataFrame, there: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each asked point the ``k`` nearest points of a cell within its radius, itself not among them; ties to the smaller."""
    if not len(asked) or not len(there):
        return pd.DataFrame([], columns=["point", "near", "distance"])
    there = there.sort_values("point")
    mine, theirs = np.array(list(asked["x"]), float), np.array(list(there["x"]), float)
    idents, names, radius = asked["point"].to_numpy(), there["point"].to_numpy(), asked["radius"].to_numpy()
    out = []
    for begin in range(0, len(mine), _TILE):
        tile = slice(begin, begin + _TILE)
        square = np.zeros((len(mine[tile]), len(theirs)))
        for d in range(mine.shape[1]):  # coordinate by coordinate: exact for equal points, and no cube of differences
            square += (mine[tile, d][:, None] - theirs[None, :, d]) ** 2
        distance = np.sqrt(square)
        distance[idents[tile][:, None] == names[None]] = np.inf
        bound = np.minimum(np.partition(distance, min(k, len(theirs)) - 1, axis=1)[:, min(k, len(theirs)) - 1], radius[tile])
        i, j = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
        order = np.lexsort((names[j], distance[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append(pd.DataFrame({"point": idents[tile][i[keep]], "near": names[j[keep]], "distance": distance[i[keep], j[keep]]}))
    return pd.concat(out)


def near_rows(rows: DataFrame, ident: str, features: list[str], k: int = 5, cell: int = 2000) -> DataFrame:
    """The ``k`` nearest other rows of each row, exactly: (row_id, near_id, distance, place), ties to the smaller id.

    Features count by their spread. Rows of equal features are one point, named by its smallest id, so that copies, however many,
    make no large cell. Points lie in cells of about ``cell``, by cuts at medians of a bounded sample. Each first looks in
    its own cell, then in those whose corners lie within the distance of the k-th found there, or everywhere if fewer were
    found. A row's nearest are then the copies of its point and of near points. Rows with a NULL feature take no part.
    """
    steps = Steps(rows.sparkSession, "near")
    rows = rows.select(F.col(ident).cast("long").alias("id"), *[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    spread = rows.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    scale = [1.0 / spread[f] if spread[f] else 0.0 for f in features]
    scaled = steps.save(rows.select("id", F.array(*[F.col(f) * s + 0.0 for f, s in zip(features, scale, strict=True)]).alias("x")))
    points = steps.save(scaled.groupBy("x").agg(F.min("id").alias("point"), F.count("*").alias("n")))
    n = points.count()
    depth = max(0, min(int(np.log2(max(n, 1) / cell)) + 1 if n > cell else 0, int(np.log2(_MOST_CELLS))))
    some = points.where(F.pmod(F.xxhash64("point"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, _SAMPLE / max(n, 1))))).select("x").toPandas()
    cells = Cells.of(np.array(list(some["x"]), float).reshape(len(some), len(features)), depth)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.place(np.array(list(batch["x"]), float)) if len(batch) else np.zeros(0, np.int64))

    placed = steps.save(points.select("point", "x").mapInPandas(celled, "point long, x array<double>, cell long"))
    corners = placed.groupBy("cell").agg(*[f(F.col("x")[d]).alias(f"{name}{d}") for d in range(len(features)) for name, f in (("low", F.min), ("high", F.max))]).toPandas()  # a row for each cell
    cells.low, cells.high = np.full((1 << depth, len(features)), np.inf), np.full((1 << depth, len(features)), -np.inf)
    for d in range(len(features)):
        cells.low[corners["cell"], d], cells.high[corners["cell"], d] = corners[f"low{d}"], corners[f"high{d}"]

    # Cells grow with the table only beyond the most cells; then a cell's points ask in lots.
    lots = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("lots"))

    def joined(asked: DataFrame) -> DataFrame:
        """``asked`` (cell, point, x, radius) against the points of their cells."""
        lot = asked.join(lots, "cell").withColumn("lot", F.pmod(F.xxhash64("point"), "lots").cast("int")).drop("lots")
        fresh = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # the same table on both sides
        there = fresh.join(lots, "cell").withColumn("lot", F.explode(F.expr("sequence(0, lots - 1)"))).drop("lots")
        return lot.groupBy("cell", "lot").cogroup(there.groupBy("cell", "lot")).applyInPandas(lambda a, b: _nearest(a, b, k), _FOUND)

    own = steps.save(joined(placed.withColumn("radius", F.lit(float("inf")))))
    reach = own.groupBy("point").agg(F.max("distance").alias("radius"), F.count("*").alias("found"))
    asked = placed.join(reach, "point", "left").withColumn("radius", F.when(F.col("found") >= k, F.col("radius")).otherwise(float("inf"))).drop("found")

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, cell_ = cells.within(np.array(list(batch["x"]), float), batch["radius"].to_numpy())
                other = cell_ != batch["cell"].to_numpy()[at]
                yield batch.iloc[at[other]].assign(cell=cell_[other])

    further = joined(asked.mapInPandas(elsewhere, "point long, x array<double>, cell long, radius double"))
    order = F.row_number().over(Window.partitionBy("point").orderBy("distance", "near"))
    near = steps.save(own.union(further).withColumn("_p", order).where(F.col("_p") <= k).drop("_p"))

    # From points to rows: of each point the k + 1 smallest ids are all that can be near.
    named = scaled.join(points.select("x", "point"), "x").select("point", "id")
    first = named.withColumn("_p", F.row_number().over(Window.partitionBy("point").orderBy("id"))).where(F.col("_p") <= k + 1)
    first = steps.save(first.groupBy("point").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    others = near.join(first.withColumnRenamed("point", "near"), "near").select("point", F.explode("ids").alias("near_id"), "distance")
    same = first.select("point", F.explode("ids").alias("near_id"), F.lit(0.0).alias("distance"))
    short = others.union(same).groupBy("point").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "near_id"))), 1, 2 * (k + 1)).alias("near"))
    made = named.join(short, "point").select("id", F.slice(F.filter("near", lambda m: m["near_id"] != F.col("id")), 1, k).alias("near"))
    return made.select(F.col("id").alias("row_id"), F.posexplode("near").alias("place", "m")).select("row_id", F.col("m.near_id").alias("near_id"), F.col("m.distance").alias("distance"), (F.col("place") + 1).alias("place"))
