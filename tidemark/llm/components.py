"""Connected components by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node reaches, from edges (a, b) of longs: node, component.

    Each round links a node's neighbours and itself to the smallest of them, which keeps what is connected and halves paths.
    It ends when every node hangs on its smallest: the edges no longer change. A hub's edges are combined before the shuffle.
    """
    canonical = lambda x, y: [F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")]
    kept = scratch.save(edges.where("a <> b").select(*canonical("a", "b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = kept.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(kept.select("lo", "hi"))
        # Written first, so that the join's own shuffle can be split at a hub.
        smallest = scratch.save(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        told = both.join(smallest, "u")
        stars = told.select(F.col("v").alias("x"), "m").union(smallest.select("u", "m")).where("x <> m")
        contracted = scratch.save(stars.select(*canonical("x", "m")).distinct())
        scratch.drop(kept, smallest)
        kept = contracted
    else:
        raise RuntimeError("components did not settle")
    held = kept.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return held.union(held.select(F.col("component").alias("node"), "component").distinct())
