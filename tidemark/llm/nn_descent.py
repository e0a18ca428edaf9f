"""Nearest neighbours by cosine on a graph that NN-descent builds.

Equal vectors are one node. Leaves of random hyperplanes give each node a first list of neighbours. Then, in each round, a
node's neighbours and some of those whose neighbour it is meet at that node with their vectors, are compared with each other,
and every list keeps the best it has been shown: neighbours of neighbours become neighbours. Queries walk the graph greedily:
the best nodes not yet visited are expanded, a few at a time, from the query's own node. Scores are exact, on the originals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as kit
from tidemark.llm.scratch import Scratch, partitions

_LISTS = pa.schema([("node", pa.int64()), ("ids", pa.binary()), ("sims", pa.binary())])
_LIST_TYPE = "node long, ids binary, sims binary"


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(batch.num_rows, -1)
    # A largest component of 1 first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def _normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.astype(np.float16).tobytes() for v in _unit(batch)], pa.binary())], ["node", "unit"])


def _rows(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32)


def _packed(node: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> list[tuple[int, bytes, bytes]]:
    """For each node its best ``most`` distinct others."""
    order = np.lexsort((-sim, other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    ends = kit.ends(first, len(node))
    return [(int(node[a]), other[a : min(z, a + most)].tobytes(), sim[a : min(z, a + most)].astype(np.float32).tobytes()) for a, z in zip(first, ends, strict=True)]


def _as_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LISTS)], schema=_LISTS)


def _leaf_lists(leaf: int, most: int):
    """Within runs of ``leaf`` rows of a sorted partition, each node's best others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        units: list[bytes] = []

        def lists(n: int) -> pa.RecordBatch:
            node, x = np.array(nodes[:n], np.int64), _rows(units[:n])
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            k = min(most, n - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((n, 0), np.int64)
            found = np.take_along_axis(sim, best, 1)
            return _as_batch([(int(a), node[b].tobytes(), s.astype(np.float32).tobytes()) for a, b, s in zip(node, best, found, strict=True)])

        for batch in batches:
            nodes.extend(batch.column("node").to_pylist())
            units.extend(batch.column("unit").to_pylist())
            while len(nodes) >= 2 * leaf:
                yield lists(leaf)
                del nodes[:leaf], units[:leaf]
        if nodes:
            yield lists(len(nodes))

    return run


def _sign_code(seed: int, planes: int):
    """The sides of random hyperplanes, in Gray order so that neighbouring codes differ by one side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("unit").to_pylist())
            normals = np.random.default_rng(seed).standard_normal((x.shape[1], planes)).astype(np.float32)
            side = (x @ normals > 0).astype(np.int64)
            code = np.bitwise_xor.accumulate(side, axis=1) @ (1 << np.arange(planes - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    return run


def _merge(most: int):
    """All lists of a partition's nodes, merged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ids, sims = [], [], []
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            nodes.append(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(b) // 8 for b in blobs]))
            ids.extend(blobs)
            sims.extend(batch.column("sims").to_pylist())
        if nodes:
            other, sim = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32)
            yield _as_batch(_packed(np.concatenate(nodes), other, sim, most))

    return run


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list as rows (node, other, sim), and for each node the least similarity that its list holds."""
    for batch in batches:
        ids = [np.frombuffer(b, np.int64) for b in batch.column("ids").to_pylist()]
        sims = [np.frombuffer(b, np.float32) for b in batch.column("sims").to_pylist()]
        count = [len(i) for i in ids]
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), count)
        worst = np.repeat([s.min() if len(s) else -2.0 for s in sims], count).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(worst)], ["node", "other", "worst"])


def _meet(most: int):
    """Rows of a partition sorted by the node they meet at: all that meet are compared, improvements go to their lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[bytes]] = ([], [], [], [])

        def compare(upto_last: bool) -> Iterator[pa.RecordBatch]:
            at, who, worst = (np.concatenate(h) for h in held[:3])
            unit = _rows(held[3])
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = kit.ends(cuts, len(at))
            stop = cuts[-1] if upto_last else len(at)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, z in zip(cuts.tolist(), ends, strict=True):
                if a >= stop or z - a < 2:
                    continue
                x = unit[a:z]
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                i, j = np.nonzero(sim > worst[a:z, None])
                found.append((who[a + i], who[a + j], sim[i, j]))
            for h in held[:3]:
                h[:] = [np.concatenate(h)[stop:]]
            del held[3][:stop]
            if found:
                yield _as_batch(_packed(*(np.concatenate(f) for f in zip(*found, strict=True)), most))

        for batch in batches:
            if not batch.num_rows:
                continue
            for h, c in zip(held[:3], ("at", "who", "worst"), strict=True):
                h.append(batch.column(c).to_numpy(zero_copy_only=False))
            held[3].extend(batch.column("unit").to_pylist())
            if len(held[3]) > 200_000:
                yield from compare(True)
        if held[3]:
            yield from compare(False)

    return run


def graph(units: DataFrame, scratch: Scratch, degree: int, back: int, rounds: int, trees: int, leaf: int) -> DataFrame:
    """Lists of ``degree`` neighbours of all nodes: node, ids, sims."""
    spark = units.sparkSession
    n = partitions(spark)
    wide = max(1, min(n, units.count() // leaf))  # so that no leaf is short of company
    parts = []
    for tree in range(trees):
        coded = units.mapInArrow(_sign_code(1000 + tree, 10), "node long, unit binary, code long")
        coded = coded.repartitionByRange(wide, "code", F.xxhash64("node")).sortWithinPartitions("code", F.xxhash64("node"))
        parts.append(coded.select("node", "unit").mapInArrow(_leaf_lists(leaf, degree), _LIST_TYPE))
    lists = parts[0]
    for more in parts[1:]:
        lists = lists.union(more)
    lists = scratch.save(lists.repartition(n, "node").mapInArrow(_merge(degree), _LIST_TYPE))
    for step in range(rounds):
        links = lists.mapInArrow(_links, "node long, other long, worst float")
        least = links.groupBy("node").agg(F.first("worst").alias("worst"))
        known = units.join(least, "node", "left").select(F.col("node").alias("who"), "unit", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
        forth = links.select(F.col("node").alias("at"), F.col("other").alias("who"))
        rank = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", F.lit(step))))
        back_links = links.withColumn("rank", rank).where(F.col("rank") <= back).select(F.col("other").alias("at"), F.col("node").alias("who"))
        meeting = forth.union(back_links).distinct().join(known, "who")
        meeting = meeting.select("at", "who", "worst", "unit").repartition(n, "at").sortWithinPartitions("at")
        better = meeting.mapInArrow(_meet(degree), _LIST_TYPE)
        merged = scratch.save(lists.union(better).repartition(n, "node").mapInArrow(_merge(degree), _LIST_TYPE))
        scratch.drop(lists)
        lists = merged
    return lists


_BEAM = pa.schema([("query", pa.int64()), ("unit", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()), ("open", pa.binary()), ("seen", pa.binary())])
_BEAM_TYPE = "query long, unit binary, ids binary, sims binary, open binary, seen binary"


def _wanted(wide: int):
    """The best ``wide`` open nodes of each beam."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, node = [], []
            for q, ids, open_ in zip(batch.column("query").to_pylist(), batch.column("ids").to_pylist(), batch.column("open").to_pylist(), strict=True):
                best = np.frombuffer(ids, np.int64)[np.frombuffer(open_, bool)][:wide]
                query.extend([q] * len(best))
                node.extend(best.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64())], ["query", "node"])

    return run


def _advance(wide: int, width: int):
    """Beams with the candidates shown to them, and the open nodes that were expanded closed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, unit, ids, sims, open_, seen, shown, units in zip(*[batch.column(c).to_pylist() for c in (*_BEAM.names, "shown", "units")], strict=True):
                ids, sims, seen = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float32), np.frombuffer(seen, np.int64)
                open_ = np.frombuffer(open_, bool).copy()
                open_[np.flatnonzero(open_)[:wide]] = False
                if shown:
                    new, at = np.unique(np.array(shown, np.int64), return_index=True)
                    fresh = ~np.isin(new, seen)
                    new, at = new[fresh], at[fresh]
                    if len(new):
                        sim = _rows([units[i] for i in at]) @ np.frombuffer(unit, np.float16).astype(np.float32)
                        seen = np.concatenate([seen, new])
                        ids, sims = np.concatenate([ids, new]), np.concatenate([sims, sim.astype(np.float32)])
                        open_ = np.concatenate([open_, np.ones(len(new), bool)])
                        best = np.lexsort((ids, -sims))[:width]
                        ids, sims, open_ = ids[best], sims[best], open_[best]
                rows.append((q, unit, ids.tobytes(), sims.tobytes(), open_.tobytes(), seen.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BEAM)], schema=_BEAM)

    return run


def _start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.array([q], np.int64).tobytes() for q in batch.column("query").to_pylist()]
        one = [np.ones(1, np.float32).tobytes()] * len(own)
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("unit"), pa.array(own, pa.binary()), pa.array(one, pa.binary()), pa.array([b"\x01"] * len(own), pa.binary()), pa.array(own, pa.binary())], schema=_BEAM)


def _beam_ids(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, np.int64)[:most] for b in batch.column("ids").to_pylist()]
            query = np.repeat(batch.column("query").to_numpy(zero_copy_only=False), [len(i) for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], ["query", "node"])

    return run


def walk(queries: DataFrame, lists: DataFrame, units: DataFrame, scratch: Scratch, width: int, wide: int, rounds: int, most: int) -> DataFrame:
    """Greedy search from each query's own node: (query, node) for the best ``most`` nodes found, the own node included."""
    beams = scratch.save(queries.mapInArrow(_start, _BEAM_TYPE))
    for _ in range(rounds):
        asked = beams.mapInArrow(_wanted(wide), "query long, node long")
        shown = asked.join(lists, "node").select("query", "node", "ids", "sims").mapInArrow(_shown, "query long, node long").distinct()
        found = shown.join(units, "node").groupBy("query").agg(F.collect_list("node").alias("shown"), F.collect_list("unit").alias("units"))
        moved = scratch.save(beams.join(found, "query", "left").mapInArrow(_advance(wide, width), _BEAM_TYPE))
        scratch.drop(beams)
        beams = moved
    return beams.mapInArrow(_beam_ids(most), "query long, node long")


def _shown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b, np.int64) for b in batch.column("ids").to_pylist()]
        query = np.repeat(batch.column("query").to_numpy(zero_copy_only=False), [len(i) for i in ids])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], ["query", "node"])


def search(
    vectors: DataFrame, every: int = 50, nearest: int = 5, degree: int = 30, back: int = 16, rounds: int = 6, trees: int = 3, leaf: int = 1024, width: int = 400, wide: int = 32, steps: int = 9
) -> DataFrame:
    """The ``nearest`` rows of ``vectors`` (vec_id, embedding) by cosine for each row whose vec_id is divisible by ``every``.

    Returns query_id, rank from 1, vec_id, score, the double-precision cosine of the originals; ties go to the smaller vec_id,
    and a query is no candidate of its own. Vectors that are null, zero, or that hold null or non-finite components take no
    part, as does a null vec_id; vectors of huge or tiny components are scaled first; shorter vectors count as if filled up with zeros. Repeated rows count once, and of several
    vectors of one vec_id the smallest in the order of arrays counts; other columns are not read.
    ``degree``, ``back``, ``rounds``, ``trees`` and ``leaf`` steer the graph, ``width``, ``wide`` and ``steps`` the walk.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nn_descent")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.where("vec_id is not null and vector is not null").where(finite)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    # Squares of very large or small components leave the range of doubles; such vectors are scaled, which leaves their cosines.
    largest = "array_max(transform(vector, x -> abs(x)))"
    scaled = f"if({largest} between 1e-100 and 1e100, vector, transform(vector, x -> x / {largest}))"
    rows = scratch.save(rows.withColumn("vector", F.expr(scaled)))
    lengths = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if lengths[0] != lengths[1]:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(lengths[1]) - F.size("vector"))))
    rows = scratch.save(rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.hash("vector")))
    # A result holds a node's smallest ids only: as many as are asked for, and the query itself.
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    some = scratch.save(rows.withColumn("place", place).where(F.col("place") <= nearest + 1))
    nodes = some.where("place = 1").select(F.col("vec_id").alias("node"), "vector", "k1", "k2")
    members = some.join(nodes.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "vec_id", "vector")
    units = scratch.save(nodes.select("node", "vector").mapInArrow(_normalised, "node long, unit binary"))
    lists = graph(units, scratch, degree, back, rounds, trees, leaf)
    asked = rows.where(F.col("vec_id") % every == 0).join(nodes.select("node", "k1", "k2"), ["k1", "k2"])
    asked = scratch.save(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "node"))
    starts = asked.select("node").distinct().join(units, "node").select(F.col("node").alias("query"), "unit")
    found = walk(starts, lists, units, scratch, width, wide, steps, nearest + 8)
    pairs = asked.join(found.withColumnRenamed("query", "own").withColumnRenamed("node", "other"), F.col("node") == F.col("own"))
    pairs = pairs.join(members.withColumnRenamed("node", "other"), "other").where("vec_id <> query_id")
    product = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    cosine = f"{product('query', 'vector')} / sqrt({product('query', 'query')}) / sqrt({product('vector', 'vector')})"
    scored = pairs.select("query_id", "vec_id", F.expr(cosine).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
