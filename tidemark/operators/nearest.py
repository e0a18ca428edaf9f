"""Cosine similarity joins by matrix products of blocks: exact, with bounds that spare most pairs of most data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import Steps

_TILE = 512  # rows of a product that are held at once
_NUMBERS = 1 << 20  # numbers of a side that are gathered at once to compare pairs
_SLACK = 1e-9  # what rounding may move in a bound


def units(vectors: Iterable) -> np.ndarray:
    """Vectors of one length as rows of length 1; null and zero ones, and those with components that aren't finite, are zeros."""
    vectors = list(vectors)
    width = next((len(v) for v in vectors if v is not None), 0)
    rows = np.array([np.zeros(width) if v is None else v for v in vectors], float).reshape(len(vectors), width)
    rows[~np.isfinite(rows).all(axis=1)] = 0.0
    largest = np.abs(rows).max(axis=1, keepdims=True, initial=0.0)
    rows = rows / np.where(largest > 0, largest, 1.0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


_BEST = "query_id long, known_id long, similarity double, met long, compared long"


def _candidates(queries: DataFrame, known: DataFrame, bucket: str, threshold: float, pivots: int, block: int) -> DataFrame:
    """For each query and block of known vectors that it meets the best one above the threshold, with the work: pairs met by
    the first quarter of their components, and pairs compared in full."""
    steps = Steps(known.sparkSession, "nearest")
    wide = lambda c: F.col(c).cast("array<double>")
    pivots = max(1, min(pivots, known.count() // block))  # cells of fewer rows than a block spare nothing
    sample = known.where("known_vector is not null").select("known_id", wide("known_vector").alias("v")).orderBy(F.xxhash64("known_id")).limit(pivots)
    centres = units([r["v"] for r in sample.collect()])
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + _SLACK

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = units(batch["v"]) @ centres.T
            yield batch.assign(cell=near.argmax(axis=1).astype(np.int32), angle=np.arccos(np.clip(near.max(axis=1), -1.0, 1.0)))

    def angled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(angles=list(np.arccos(np.clip(units(batch["v"]) @ centres.T, -1.0, 1.0))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["query_id", "known_id", "similarity", "met", "compared"])
        q, k, ids = units(left["v"]), units(right["v"]), right["known_id"].to_numpy()
        head = max(1, q.shape[1] // 4)
        q_rest, k_rest = np.linalg.norm(q[:, head:], axis=1), np.linalg.norm(k[:, head:], axis=1)
        rows = []
        for begin in range(0, len(q), _TILE):
            tile = slice(begin, begin + _TILE)
            # Of the rest of the components the product of the norms is all that is to be had.
            i, j = np.nonzero(q[tile, :head] @ k[:, :head].T + np.outer(q_rest[tile], k_rest) > threshold - _SLACK)
            similarity = np.empty(len(i))
            for part in range(0, len(i), pairs := max(1, _NUMBERS // max(q.shape[1], 1))):
                some = slice(part, part + pairs)
                similarity[some] = np.einsum("ij,ij->i", q[tile][i[some]], k[j[some]])
            above = similarity > threshold
            order = np.lexsort((ids[j[above]], -similarity[above], i[above]))
            i_, j_, s_ = i[above][order], j[above][order], similarity[above][order]
            first = np.ones(len(i_), bool)
            first[1:] = i_[1:] != i_[:-1]
            made = {a: (ids[b], s) for a, b, s in zip(i_[first], j_[first], s_[first], strict=True)}
            compared = np.bincount(i, minlength=len(q[tile]))
            rows.extend((query, *made.get(n, (None, None)), len(k), compared[n]) for n, query in enumerate(left["query_id"].to_numpy()[tile]))
        made = pd.DataFrame(rows, columns=["query_id", "known_id", "similarity", "met", "compared"])
        return made.astype({"known_id": "Int64"})

    rows = known.where(F.col(bucket).isNotNull() & F.col("known_vector").isNotNull()).select(F.col(bucket).alias("bucket"), F.col("known_id").cast("long").alias("known_id"), wide("known_vector").alias("v"))
    kind = rows.schema["bucket"].dataType.simpleString()
    cells = steps.save(rows.mapInPandas(celled, f"bucket {kind}, known_id long, v array<double>, cell int, angle double"))
    rings = cells.groupBy("bucket", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rings = steps.save(rings)
    asked = queries.where(F.col("query_vector").isNotNull()).select(F.col(bucket).alias("bucket"), F.col("query_id").cast("long").alias("query_id"), wide("query_vector").alias("v"))
    lots = asked.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("lots"))
    asked = asked.join(lots, "bucket").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots").cast("int")).select("bucket", "query_id", "v", "lot")
    asked = asked.mapInPandas(angled, f"bucket {kind}, query_id long, v array<double>, lot int, angles array<double>")
    # The blocks of each cell of the query's bucket whose ring of angles around its pivot the query reaches: joined, so that no
    # batch in Python holds a query as often as it has blocks.
    angle, there = F.get(asked["angles"], rings["cell"]), asked["bucket"] == rings["bucket"]
    met = asked.join(rings, there & (angle >= F.col("low") - reach) & (angle <= F.col("high") + reach))
    met = met.select(asked["bucket"], "query_id", "v", "lot", "cell", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    dealt = cells.join(rings.select("bucket", "cell", "blocks"), ["bucket", "cell"]).join(lots, "bucket")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("known_id"), "blocks").cast("int")).withColumn("lot", F.explode(F.expr("sequence(0, lots - 1)")))
    task = ["bucket", "cell", "block", "lot"]
    return met.groupBy(*task).cogroup(dealt.select(*task, "known_id", "v").groupBy(*task)).applyInPandas(best, _BEST)


def nearest_within(queries: DataFrame, known: DataFrame, bucket: str, threshold: float = 0.9, pivots: int = 64, block: int = 4096) -> DataFrame:
    """JOIN-08: the most similar known vector of the same bucket, above a threshold, ties to the smaller id: query_id, known_id, similarity.

    Known vectors lie in cells around the nearest of ``pivots`` of them, of fewer where the table is small. By the triangle inequality of angles a query needs only
    cells whose ring of angles around the pivot it can reach; of a cell's pairs, met in blocks of ``block`` by ``block`` rows,
    only those are compared in full whose first components, with the norms of the rest, can reach the threshold. Both bounds
    are safe: results don't depend on ``pivots`` or ``block``. Null and zero vectors, and a NULL bucket, match nothing.
    """
    found = _candidates(queries, known, bucket, threshold, pivots, block).where("known_id is not null")
    best = found.groupBy("query_id").agg(F.max(F.struct("similarity", -F.col("known_id"))).alias("m"))
    return best.select("query_id", (-F.col("m.col2")).alias("known_id"), F.col("m.similarity").alias("similarity"))


def _against(texts: DataFrame, hooks: DataFrame, task, schema: str, label: str, most: int = 10_000) -> DataFrame:
    """``task`` of each text and a block of at most about ``most`` hooks, for all blocks; a block is counted, then broadcast."""
    session = texts.sparkSession
    hooks = hooks.select(F.col(label).cast("long").alias("label"), F.col("hook_vector").cast("array<double>").alias("v"))
    blocks = -(-hooks.count() // most) or 1
    rows = texts.where("vector is not null").select(F.col("text_id").cast("long").alias("text_id"), F.col("vector").cast("array<double>").alias("v"))
    made = None
    for block in range(blocks):
        own = (hooks if blocks == 1 else hooks.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == block)).toPandas().sort_values("label", kind="stable")
        known = session.sparkContext.broadcast((own["label"].to_numpy(), units(own["v"])))

        def scored(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            labels, there = known.value
            for batch in batches:
                for begin in range(0, len(batch) if len(labels) else 0, _TILE):
                    part = batch.iloc[begin : begin + _TILE]
                    mine = units(part["v"])
                    if mine.shape[1]:
                        yield task(part["text_id"].to_numpy(), mine, labels, there)

        found = rows.mapInPandas(scored, schema)
        made = found if made is None else made.union(found)
    return made


def _top_three(idents: np.ndarray, mine: np.ndarray, labels: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    """Of each row the three most similar, ties to the smaller label; those near the third are computed pair by pair, so that
    equal vectors are equally similar wherever they lie in a product."""
    near = mine @ there.T
    third = np.partition(near, -min(3, len(labels)), axis=1)[:, -min(3, len(labels))]
    i, j = np.nonzero(near >= third[:, None] - _SLACK)
    similarity = np.einsum("ij,ij->i", mine[i], there[j])
    order = np.lexsort((labels[j], -similarity, i))
    i, j, similarity = i[order], j[order], similarity[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < 3
    return pd.DataFrame({"text_id": idents[i[keep]], "hook_id": labels[j[keep]], "similarity": similarity[keep]})


def _best_of_each(idents: np.ndarray, mine: np.ndarray, labels: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    """The largest similarity to each label's vectors, which lie together."""
    names, starts = np.unique(labels, return_index=True)
    best = np.maximum.reduceat(mine @ there.T, starts, axis=1)
    return pd.DataFrame({"text_id": np.repeat(idents, len(names)), "category": np.tile(names, len(idents)), "similarity": best.ravel()})


def hook_scores(texts: DataFrame, hooks: DataFrame, most: int = 10_000) -> DataFrame:
    """TXT-14: the largest similarity of a vector to a corpus of hooks, the mean of the best three, their ids and a band.

    Texts meet the corpus as products of matrices, block by block of ``most`` hooks, and keep three of each block. A text
    without a vector has no row; a zero vector has similarity 0.
    """
    found = _against(texts, hooks, _top_three, "text_id long, hook_id long, similarity double", "hook_id", most)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "hook_id"))), 1, 3)  # three for each block
    made = found.groupBy("text_id").agg(best.alias("best"))
    made = made.select("text_id", (-F.col("best")[0]["s"]).alias("max_similarity"), (-F.aggregate("best", F.lit(0.0), lambda s, b: s + b["s"]) / F.size("best")).alias("top3_avg"), F.col("best.hook_id").alias("top_hooks"))
    s = F.col("max_similarity")
    return made.withColumn("strength", F.when(s >= 0.7, "strong").when(s >= 0.5, "moderate").when(s >= 0.3, "weak").otherwise("minimal"))


def category_scores(texts: DataFrame, hooks: DataFrame, most: int = 10_000) -> DataFrame:
    """TXT-15: the largest similarity to each category of hooks, by the same products."""
    found = _against(texts, hooks, _best_of_each, "text_id long, category long, similarity double", "category", most)
    return found.groupBy("text_id", "category").agg(F.max("similarity").alias("similarity"))
