"""Gradient-boosted regression trees for every key at once, and exact contributions of their features.

All keys' trees grow level by level together: one job sums residuals by key, node, feature and bin, and picks every node's best
split. The number of jobs is trees times depth, whatever the number of keys, and no key's rows meet in one task.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import Counted
from tidemark.operators.tables import Steps

_PIECE = 20_000  # rows of a key that are scored at once


@dataclass
class Forest:
    """``table``: a row for each key: ``key``, ``start`` and ``splits``, (tree, node, feature, threshold, left, right, n_left, n_right).

    A tree's root is node 1, and node i has children 2i, for values up to the threshold, and 2i + 1. ``left`` and ``right`` are the
    children's mean residuals; a prediction is the start and ``step`` times the value of each tree's last node.
    """

    table: DataFrame
    features: list[str]
    step: float


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def _named(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("\0"))


def fit(rows: DataFrame, key: str, features: list[str], label: str, trees: int = 20, depth: int = 4, step: float = 0.1, bins: int = 32) -> Forest:
    """ML-01: boosted trees of squared error for each ``key`` of ``rows``, split at quantiles of the key's own values.

    NULL features count as 0, rows without a label are left out, and a NULL key is one. Ties go to the earlier feature, then the
    smaller threshold, so a key's trees are those that it would get alone. Trees see no more of a key's rows of equal bins than
    their number and the sum of their residuals, so such rows are one cell, and only the first steps pass over rows.
    """
    steps = Steps(rows.sparkSession, "trees")
    named = steps.save(rows.where(F.col(label).isNotNull()).select(_named(key).alias("key"), _vector(features).alias("x"), F.col(label).cast("double").alias("y")))
    values = named.select("key", F.posexplode("x").alias("f", "v"))
    quantiles = Counted(values, "v", ["key", "f"]).quantiles([i / bins for i in range(1, bins)])
    cuts = quantiles.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("f", F.array_distinct("q").alias("q")))).alias("cuts"))
    start = named.groupBy("key").agg(F.avg("y").alias("start"))
    known = steps.save(cuts.join(start, "key").select("key", "start", F.col("cuts.q").alias("edges")))
    binned = F.zip_with("x", "edges", lambda x, edges: F.size(F.filter(edges, lambda e: e < x)))
    residual = named.join(known, "key").select("key", binned.alias("b"), (F.col("y") - F.col("start")).alias("r"))
    state = steps.save(residual.groupBy("key", "b").agg(F.sum("r").alias("r"), F.count("*").alias("n")))

    def placed(rows: DataFrame, splits: DataFrame | None, levels: int) -> DataFrame:
        """``node`` of each row after the splits so far."""
        if splits is None:
            return rows.withColumn("node", F.lit(1))
        by_key = splits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "bin", "left", "right")))).alias("m"))
        made = rows.join(by_key, "key", "left").withColumn("node", F.lit(1))
        for _ in range(levels):
            s = F.try_element_at("m", F.col("node"))
            below = (F.get("b", s["f"]) > s["bin"]).cast("int")
            made = made.withColumn("node", F.when(s.isNull(), F.col("node")).otherwise(F.col("node") * 2 + below))
        return made

    grown = []
    for tree in range(trees):
        splits, levels = None, []
        for level in range(depth):
            at = placed(state, splits, level).where(F.col("node") >= 1 << level)
            sums = at.select("key", "node", "r", "n", F.posexplode("b").alias("f", "bin")).groupBy("key", "node", "f", "bin").agg(F.sum("r").alias("s"), F.sum("n").alias("n"))
            levels.append(steps.save(_best(sums)))
            splits = levels[0] if level == 0 else splits.union(levels[-1])
        s = F.try_element_at("m", (F.col("node") / 2).cast("int"))
        value = F.coalesce(F.when(F.col("node") % 2 == 0, s["left"]).otherwise(s["right"]), F.lit(0.0))
        moved = steps.save(placed(state, splits, depth).select("key", "b", (F.col("r") - F.col("n") * value * step).alias("r"), "n"))
        steps.drop(state)
        state = moved
        grown.append(splits.withColumn("tree", F.lit(tree)))
    every = grown[0]
    for more in grown[1:]:
        every = every.union(more)
    every = every.join(known.select("key", "edges"), "key")
    split = F.struct("tree", "node", F.col("f").alias("feature"), F.get(F.get("edges", F.col("f")), F.col("bin")).alias("threshold"), "left", "right", "n_left", "n_right")
    by_key = every.groupBy("key").agg(F.array_sort(F.collect_list(split)).alias("splits"))
    return Forest(steps.save(known.select("key", "start").join(by_key, "key", "left")), features, step)


def _best(sums: DataFrame) -> DataFrame:
    """The split of largest gain of each key and node: f, bin, and the children's means and sizes."""
    own = Window.partitionBy("key", "node", "f")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    made = sums.select("key", "node", "f", "bin", F.sum("s").over(upto).alias("sl"), F.sum("n").over(upto).alias("nl"), F.sum("s").over(own).alias("st"), F.sum("n").over(own).alias("nt"))
    made = made.withColumns({"sr": F.col("st") - F.col("sl"), "nr": F.col("nt") - F.col("nl")}).where("nr > 0")
    gain = F.col("sl") ** 2 / F.col("nl") + F.col("sr") ** 2 / F.col("nr") - F.col("st") ** 2 / F.col("nt")
    best = F.max(F.struct(F.round(gain, 9).alias("gain"), -F.col("f"), -F.col("bin"), "sl", "nl", "sr", "nr"))
    picked = made.groupBy("key", "node").agg(best.alias("m")).where("m.gain > 0")
    means = [(F.col(f"m.s{side}") / F.col(f"m.n{side}")).alias(name) for side, name in (("l", "left"), ("r", "right"))]
    return picked.select("key", "node", (-F.col("m.col2")).alias("f"), (-F.col("m.col3")).alias("bin"), *means, F.col("m.nl").alias("n_left"), F.col("m.nr").alias("n_right"))


def _trees(splits) -> list[dict[int, dict]]:
    made: dict[int, dict[int, dict]] = {}
    for s in [] if splits is None else splits:
        made.setdefault(s["tree"], {})[s["node"]] = s
    return [made[t] for t in sorted(made)]


def _matrix(mine: pd.DataFrame, width: int) -> np.ndarray:
    return mine[[f"_x{i}" for i in range(width)]].to_numpy(float)


def _predicted(x: np.ndarray, start: float, splits, step: float) -> np.ndarray:
    made = np.full(len(x), start)
    for tree in _trees(splits):
        node, value = np.ones(len(x), np.int64), np.zeros(len(x))
        for name in sorted(tree):  # parents come before children
            s, here = tree[name], node == name
            right = x[:, s["feature"]] > s["threshold"]
            node[here] = 2 * name + right[here]
            value[here] = np.where(right[here], s["right"], s["left"])
        made += step * value
    return made


def _with_models(forest: Forest, rows: DataFrame, key: str, ident: str, task, schema: str) -> DataFrame:
    """``task`` of pieces of a key's rows (key, id, a column for each feature) and the key's model."""
    named = rows.select(_named(key).alias("key"), F.col(ident).cast("long").alias("id"), *[F.get(_vector(forest.features), F.lit(i)).alias(f"_x{i}") for i in range(len(forest.features))])
    pieces = named.groupBy("key").agg(F.ceil(F.count("*") / _PIECE).cast("int").alias("pieces"))
    pieces = Steps(rows.sparkSession, "pieces").save(pieces)
    dealt = named.join(pieces, "key").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
    fresh = pieces.select(F.col("key").alias("key"), F.col("pieces").alias("pieces"))  # the same table on both sides
    models = forest.table.join(fresh, "key").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    return dealt.groupBy("key", "piece").cogroup(models.groupBy("key", "piece")).applyInPandas(task, schema)


def score(forest: Forest, rows: DataFrame, key: str, ident: str) -> DataFrame:
    """(row_id, prediction) of each row of ``rows`` by its key's trees; rows of a key without a model have no row."""
    step, width = forest.step, len(forest.features)

    def task(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model) or not len(mine):
            return pd.DataFrame([], columns=["row_id", "prediction"])
        return pd.DataFrame({"row_id": mine["id"], "prediction": _predicted(_matrix(mine, width), model["start"].iloc[0], model["splits"].iloc[0], step)})

    return _with_models(forest, rows, key, ident, task, "row_id long, prediction double")


def _paths(tree: dict[int, dict]) -> list[tuple[float, dict[int, list[float]]]]:
    """The tree's leaves: value, and for each feature on the way [low, high, share]: the open and closed end of the values that go
    this way, and the share of rows that do where the feature isn't known."""
    out = []

    def walk(node: int, value: float, way: dict[int, list[float]]) -> None:
        s = tree.get(node)
        if s is None:
            out.append((value, way))
            return
        whole = s["n_left"] + s["n_right"]
        for child, n, side in ((2 * node, s["n_left"], 1), (2 * node + 1, s["n_right"], 0)):
            low, high, share = way.get(s["feature"], [-math.inf, math.inf, 1.0])
            ends = [low, min(high, s["threshold"])] if side else [max(low, s["threshold"]), high]
            walk(child, s["left"] if side else s["right"], way | {s["feature"]: [*ends, share * n / whole]})

    walk(1, 0.0, {})
    return out


def _shapley(x: np.ndarray, splits, step: float, width: int) -> np.ndarray:
    """Exact Shapley values of trees at ``x``: a leaf is a game of the few features on its way."""
    made = np.zeros((len(x), width))
    for tree in _trees(splits):
        for value, way in _paths(tree):
            names = list(way)
            m = len(names)
            known = np.stack([(x[:, f] > way[f][0]) & (x[:, f] <= way[f][1]) for f in names], axis=1).astype(float) if m else np.zeros((len(x), 0))
            share = np.array([way[f][2] for f in names])
            for i in range(m):
                others = [j for j in range(m) if j != i]
                weight = np.zeros(len(x))
                for size in range(m):
                    factor = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    for some in itertools.combinations(others, size):
                        rest = [j for j in others if j not in some]
                        weight += factor * known[:, list(some)].prod(axis=1) * share[rest].prod()
                made[:, names[i]] += step * value * (known[:, i] - share[i]) * weight
    return made


def contributions(forest: Forest, rows: DataFrame, key: str, ident: str) -> DataFrame:
    """ML-10: what each feature adds to each row's prediction: (row_id, feature, value).

    Exact Shapley values where an unknown feature follows the shares of training rows; a row's sum to its prediction less
    the mean of its key's model over the training rows' ways.
    """
    features, step = forest.features, forest.step

    def task(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model) or not len(mine):
            return pd.DataFrame([], columns=["row_id", *values])
        made = _shapley(_matrix(mine, len(features)), model["splits"].iloc[0], step, len(features))
        return pd.DataFrame({"row_id": mine["id"].to_numpy()} | {v: made[:, i] for i, v in enumerate(values)})

    values = [f"_v{i}" for i in range(len(features))]
    made = _with_models(forest, rows, key, ident, task, ", ".join(["row_id long", *[f"{v} double" for v in values]]))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(v).alias("value")) for f, v in zip(features, values, strict=True)])
    return made.select("row_id", F.inline(pairs))
