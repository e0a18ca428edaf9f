"""De-duplication of vectors in input order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.nearest import units
from tidemark.operators.tables import Steps

_TILE = 256  # rows of a similarity matrix that are looked at together


def _first_kept(idents: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    """For rows in order the place of the row that each is kept as: the first kept one above the threshold, else itself."""
    kept, owner = np.zeros(0, np.int64), np.arange(len(rows))
    for begin in range(0, len(rows), _TILE):
        tile = rows[begin : begin + _TILE]
        if len(kept):
            above = tile @ rows[kept].T > threshold
            hit = above.any(axis=1)
            owner[begin : begin + len(tile)][hit] = kept[above.argmax(axis=1)[hit]]
        else:
            hit = np.zeros(len(tile), bool)
        among, new = tile @ tile.T > threshold, []
        for i in np.flatnonzero(~hit):
            if hit[i]:
                continue
            new.append(begin + i)
            later = np.flatnonzero(among[i, i + 1 :] & ~hit[i + 1 :]) + i + 1
            owner[begin + later], hit[later] = begin + i, True
        kept = np.concatenate([kept, np.array(new, np.int64)])
    return owner


def greedy(rows: DataFrame, key: str, ident: str, vector: str, threshold: float = 0.9, block: int = 4096) -> DataFrame:
    """SEQ-05: in the order of ``ident`` a row is merged into the first kept one above the threshold, else kept itself.

    A round takes the first ``block`` undecided rows of each key, which are decided in order, a key in a task; then the key's
    other rows, dealt in pieces of about ``block``, are merged into what the round kept or stay for the next. As kept rows come
    in order, the first round that merges a row merges it into the right one. So no task holds more than two blocks, rounds
    grow with the rows that a key keeps, and pairs are never written: copies and near copies, however many, go in one round.

    Returns ``ident``, the ident that it is ``kept_as``, and ``times``, how many rows a kept one stands for, 0 for merged ones.
    Null and zero vectors are like no other; a NULL key is a key; ``ident`` is unique. A key's vectors have one length.
    """
    steps = Steps(rows.sparkSession, "greedy")
    rest = steps.save(rows.select(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_key"), F.col(ident).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")))

    def decided(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id")
        idents = group["_id"].to_numpy()
        owner = _first_kept(idents, units(group["_v"]), threshold)
        kept = owner == np.arange(len(owner))
        return pd.DataFrame({"_key": group["_key"].to_numpy(), "_id": idents, "_as": idents[owner], "_v": [v if k else None for v, k in zip(group["_v"], kept, strict=True)]})

    def merged(key: tuple, others: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        kept = kept.sort_values("_id")
        there, idents, out_id, out_as = units(kept["_v"]), kept["_id"].to_numpy(), [], []
        mine, asked = units(others["_v"]), others["_id"].to_numpy()
        for begin in range(0, len(mine) if len(kept) else 0, _TILE):
            above = mine[begin : begin + _TILE] @ there.T > threshold
            hit = above.any(axis=1)
            out_id.append(asked[begin : begin + _TILE][hit])
            out_as.append(idents[above.argmax(axis=1)[hit]])
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"_key": key[0], "_id": whole(out_id), "_as": whole(out_as)})

    found = None
    order = F.row_number().over(Window.partitionBy("_key").orderBy("_id"))
    while True:
        head = rest.withColumn("_n", order).where(F.col("_n") <= block).drop("_n")
        made = steps.save(head.groupBy("_key").applyInPandas(decided, "_key string, _id long, _as long, _v array<double>"))
        pairs = made.select("_id", "_as")
        found = pairs if found is None else found.union(pairs)
        others = steps.save(rest.join(made.select("_id"), "_id", "left_anti"))
        sizes = steps.save(others.groupBy("_key").agg(F.ceil(F.count("*") / block).cast("int").alias("_pieces")))
        if sizes.isEmpty():
            break
        others = others.join(sizes, "_key").withColumn("_piece", F.pmod(F.xxhash64("_id"), "_pieces").cast("int")).drop("_pieces")
        kept = made.where("_id = _as").join(sizes, "_key").withColumn("_piece", F.explode(F.expr("sequence(0, _pieces - 1)"))).select("_key", "_piece", "_id", "_v")
        hits = steps.save(others.groupBy("_key", "_piece").cogroup(kept.groupBy("_key", "_piece")).applyInPandas(merged, "_key string, _id long, _as long"))
        found = found.union(hits.select("_id", "_as"))
        rest = steps.save(others.drop("_piece").select("_key", "_id", "_v").join(hits.select("_id"), "_id", "left_anti"))
    times = found.groupBy("_as").agg(F.count("*").alias("times"))
    made = found.join(times.withColumnRenamed("_as", "_kept"), F.col("_id") == F.col("_kept"), "left")
    return made.select(F.col("_id").alias(ident), F.col("_as").alias("kept_as"), F.coalesce("times", F.lit(0)).alias("times"))
