"""The learner of feedback over a table: blocks of a niche learn side by side, with the results of one pass in order.

A step of least mean squares, w + a (y - w.x) x, is an affine map of the weights, and maps compose: of a block that began with any
weights it is known what it makes of them. So blocks are composed each by itself, one small matrix for each is folded in
order, and then every block, its weights known, measures its own errors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import shuffles
from tidemark.operators.tables import Steps, batches_by_rows

_TILE = 16  # rows that are solved for together
_STACK = 32  # blocks that are
_RANGE = 1_000_000  # rows of a range, the work of a task
_TOGETHER = 100_000  # rows of a range that are parted by niche together


def steps_of(weights: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (blocks, features, columns) after learning the rows ``x`` and ``y`` (blocks, rows, features or columns) of each block
    in order, and each row's error before it was learned. Rows of zeros at the end move nothing.

    Within a tile an error is the row's residual under the weights before, less what the tile's earlier rows have moved. The rows
    of one place in all tiles of all blocks are solved at once, for ``y`` and for each feature; only the weights pass from tile to tile.
    """
    blocks, n, k, columns = *x.shape, y.shape[2]
    tiles = -(-n // _TILE)
    both = np.zeros((blocks, tiles * _TILE, k + columns))
    both[:, :n, :k], both[:, :n, k:] = x, y
    both = np.ascontiguousarray(both.reshape(blocks, tiles, _TILE, k + columns).transpose(2, 3, 1, 0))
    moved = np.zeros((k, k + columns, tiles, blocks))
    for row in both:
        part = row[:k].copy()
        gained = part * (rate / (1.0 + (part * part).sum(axis=0)))
        for i in range(k):
            row -= part[i] * moved[i]
        for i in range(k):
            moved[i] += gained[i] * row
    keeps, adds = (np.ascontiguousarray(m.transpose(2, 3, 0, 1)) for m in (np.eye(k)[:, :, None, None] - moved[:, :k], moved[:, k:]))
    before = np.empty((tiles, blocks, k, columns))
    for tile in range(tiles):
        before[tile] = weights
        weights = keeps[tile] @ weights + adds[tile]
    errors, before = both[:, k:], before.transpose(2, 3, 0, 1)
    for i in range(k):
        errors = errors - both[:, i, None] * before[i]
    return weights, errors.transpose(3, 2, 0, 1).reshape(blocks, -1, columns)[:, :n]


class _Blocks:
    """A table of feedback in blocks (part, at) of a niche: ``packed``, a row for each with its ``n`` rows' values as one binary and
    what it makes of the weights, and ``starts``, its niche's rows before it and the weights before and after it. Rows that lack a value
    are left out.

    Rows are dealt once, by range of niche and order, in as many ranges as they need; each task parts its own by niche, packs and
    composes them in order, so a block ends with the niche's rows of a task, and blocks of a niche come in the order of (part, at).
    """

    def __init__(self, feedback: DataFrame, features: list[str], targets: list[str], rate: float, block: int):
        self.width, self.n_targets = len(features) + 1, len(targets)
        width, n_targets = self.width, self.n_targets
        self.steps = Steps(feedback.sparkSession, "learned")
        named = [F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate([*features, *targets])]
        values = [f"_v{i}" for i in range(len(named))]
        rows = self.steps.save(feedback.select(F.coalesce(F.col("niche").cast("string"), F.lit("\0")).alias("niche"), "seq", *named))  # ranges read them twice
        ranges = max(shuffles(rows), -(-rows.count() // _RANGE))
        rows = rows.na.drop(subset=values)  # of what is written: a condition on the source would work out its values once more
        dealt = rows.repartitionByRange(ranges, "niche", "seq", *values).sortWithinPartitions("seq", *values)  # numbers first: names are slow to order
        arrays = self.arrays

        def composed(parts: list[np.ndarray]) -> np.ndarray:
            """What each block makes of the weights: targets learned from nothing, and the image of each unit vector."""
            x, y = arrays(parts, width)
            none = np.hstack([np.zeros((width, n_targets)), np.eye(width)])
            return steps_of(np.stack([none] * len(x)), x, np.concatenate([y, np.zeros_like(x)], axis=2), rate)[0].reshape(len(x), -1)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at, codes = TaskContext.get().partitionId(), 0, {}
            held, waiting = [(np.zeros(0, int), np.zeros((0, len(values))))], 0

            def blocks(least: int) -> Iterator[dict]:
                """Of what is held, blocks of at least ``least`` rows of a niche, in order; the rest stays held, by niche."""
                nonlocal at, held, waiting
                code, v = (np.concatenate(c) for c in zip(*held, strict=True))
                order, names = np.argsort(code, kind="stable"), list(codes)
                code, v = code[order], v[order]
                begins = np.flatnonzero(np.diff(code, prepend=-1))
                ends, rest = np.append(begins[1:], len(code)), np.ones(len(code), bool)
                for i in np.flatnonzero(ends - begins >= least):
                    for begin in range(begins[i], ends[i] - least + 1, block):
                        mine = v[begin : min(begin + block, ends[i])]
                        rest[begin : begin + len(mine)] = False
                        yield {"niche": names[code[begin]], "part": part, "at": at, "n": len(mine), "v": mine}
                        at += 1
                held, waiting = [(code[rest], v[rest])], 0

            def written(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
                for some in itertools.batched(found, _STACK):
                    maps = composed([b["v"] for b in some]).tolist()
                    yield pa.RecordBatch.from_pylist([b | {"v": b["v"].tobytes(), "map": m} for b, m in zip(some, maps, strict=True)], schema)

            for batch in batches:
                niche = batch.column("niche").dictionary_encode()
                known = np.array([codes.setdefault(n, len(codes)) for n in niche.dictionary.to_pylist()], int)
                held.append((known[niche.indices.to_numpy()], np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in values], axis=1)))
                waiting += batch.num_rows
                if waiting >= max(_TOGETHER, len(held[0][0])):  # what stayed is gone through again when as much has come
                    yield from written(blocks(block))
            yield from written(blocks(1))

        schema = pa.schema([("niche", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("v", pa.binary()), ("map", pa.list_(pa.float64()))])

        def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The rows before each block, and the weights that it begins and ends with; blocks of a niche come in order."""
            niche, weights, first = None, None, 0
            for batch in batches:
                before, out = [], [np.zeros(0)]
                for name, n, made in zip(batch["niche"], batch["n"], batch["map"], strict=True):
                    if name != niche:
                        niche, weights, first = name, np.zeros((width, n_targets)), 0
                    out.append(weights.ravel())
                    made = np.asarray(made).reshape(width, n_targets + width)
                    weights = made[:, :n_targets] + made[:, n_targets:] @ weights
                    out.append(weights.ravel())
                    before.append(first)
                    first += n
                yield pd.DataFrame({"niche": batch["niche"], "part": batch["part"], "at": batch["at"], "first": before, "weights": out[1::2], "after": out[2::2]})

        with batches_by_rows(feedback.sparkSession):
            self.packed = self.steps.save(dealt.select("niche", *values).mapInArrow(packed, "niche string, part int, at long, n long, v binary, map array<double>"))
        maps = self.packed.select("niche", "part", "at", "n", "map").repartition("niche").sortWithinPartitions("niche", "part", "at")
        self.starts = self.steps.save(maps.mapInPandas(folded, "niche string, part int, at long, first long, weights array<double>, after array<double>"))

    @staticmethod
    def arrays(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Features with the constant, and targets, of several blocks as a stack; rows that a block lacks are zeros."""
        n = max(map(len, parts))
        x, y = np.zeros((len(parts), n, width)), np.zeros((len(parts), n, parts[0].shape[1] - width + 1))
        for i, v in enumerate(parts):
            x[i, : len(v), :-1], x[i, : len(v), -1], y[i, : len(v)] = v[:, : width - 1], 1.0, v[:, width - 1 :]
        return x, y


def online_weights(feedback: DataFrame, features: list[str], target: str, rate: float = 0.5, block: int = 3000) -> DataFrame:
    """The learner's weights after all of a niche's rows: niche, ``online``, one for each feature and a last one for the constant."""
    made = _Blocks(feedback, features, [target], rate, block).starts
    return made.groupBy("niche").agg(F.max_by("after", F.struct("part", "at")).alias("online")).withColumn("niche", F.nullif(F.col("niche"), F.lit("\0")))


def learned_in_blocks(
    feedback: DataFrame, features: list[str], targets: list[str], rate: float = 0.5, burn_in: int = 10, every: int = 15, deep: int = 50, bounds: tuple[float, float] | None = None, block: int = 3000
) -> DataFrame:
    """STR-03...07 over a table of feedback (niche, seq, features, targets): the event rows of ``Learner``.

    A niche's rows are dealt by ``seq`` over ranges and packed in blocks of at most ``block``; a task holds one, and the fold
    over a niche holds one block's matrix of (features + 1) squared at a time. Equal ``seq`` go by their values; a NULL niche is one.
    """
    blocks = _Blocks(feedback, features, targets, rate, block)
    steps, arrays, width, n_targets = blocks.steps, blocks.arrays, blocks.width, blocks.n_targets

    def measured(niche: str, part: int, at: int, first: int, y: np.ndarray, errors: np.ndarray) -> pa.RecordBatch:
        """The block's sums at its events and, as sample 0, at its end: |e|, e squared, y and y squared, by target; the sum of |e|
        over targets there and, if it lies in the block, at the event before (at the end, the last one)."""
        if bounds:
            shown = np.clip(y - errors, *bounds)
            if first == 0:
                shown[0] = sum(bounds) / 2
            errors = y - shown
        sums = np.vstack([np.zeros((1, n_targets, 4)), np.cumsum(np.stack([np.abs(errors), errors**2, y, y**2], axis=2), axis=0)])
        total = sums[:, :, 0].sum(axis=1)
        samples = first + np.arange(1, len(y) + 1)
        events = np.flatnonzero(((samples >= burn_in) & (samples % every == 0)) | (samples % deep == 0)) + 1
        places, named = np.append(events, len(y)), np.append(first + events, 0)
        before = (places + first) // every * every - np.append(np.full(len(events), every), 0) - first
        earlier = np.where(before > 0, total[np.maximum(before, 0)], np.nan)
        n = len(places) * n_targets
        columns = [pa.repeat(niche, n), pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(at, pa.int64()), n), np.repeat(named, n_targets), pa.array(targets * len(places))]
        return pa.RecordBatch.from_arrays([*map(pa.array, [*columns, *sums[places].reshape(-1, 4).T.copy(), np.repeat(total[places], n_targets)]), pa.array(np.repeat(earlier, n_targets), from_pandas=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _STACK):
                some = batch.slice(begin, _STACK).to_pylist()
                x, y = arrays([np.frombuffer(b["v"]).reshape(-1, width - 1 + n_targets) for b in some], width)
                _, errors = steps_of(np.array([b["weights"] for b in some]).reshape(-1, width, n_targets), x, y, rate)
                for i, b in enumerate(some):
                    n = b["n"]
                    yield measured(b["niche"], b["part"], b["at"], b["first"], y[i, :n], errors[i, :n])

    names = ["niche", "part", "at", "samples", "target", "a", "s", "y", "q", "total", "before"]
    held = blocks.packed.select("niche", "part", "at", "n", "v").join(blocks.starts.select("part", "at", "first", "weights"), ["part", "at"]).select("niche", "part", "at", "n", "v", "first", "weights")
    found = held.mapInArrow(each, "niche string, part int, at long, samples long, target string, a double, s double, y double, q double, total double, before double")
    found = steps.save(found)
    earlier = Window.partitionBy("niche", "target").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = found.where("samples = 0").withColumns({f"{c}_0": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("a", "s", "y", "q", "total")})
    ends = ends.withColumn("last", F.coalesce(F.last(F.col("total_0") + F.col("before"), ignorenulls=True).over(earlier), F.lit(0.0)))
    ends = steps.save(ends.select("part", "at", "target", *[f"{c}_0" for c in ("a", "s", "y", "q", "total")], "last"))  # of known size, so events stay where they are
    rows = found.where("samples > 0").join(ends, ["part", "at", "target"])
    at, upto = F.col("samples"), lambda c: F.col(c) + F.col(f"{c}_0")
    spread = upto("q") - upto("y") * upto("y") / at
    improved = (at - every >= burn_in) & (upto("total") / at < 0.95 * F.coalesce(F.col("before") + F.col("total_0"), "last") / (at - every))
    regular = F.when((at >= burn_in) & (at % every == 0), F.when(improved, "retrain").otherwise("steady"))
    events = F.array_compact(F.array(regular, F.when(at % deep == 0, "evaluate")))
    niche = F.nullif(F.col("niche"), F.lit("\0"))
    return rows.select(niche.alias("niche"), "target", "samples", (upto("a") / at).alias("mae"), F.when(spread > 0, 1 - upto("s") / spread).otherwise(0.0).alias("r2"), F.explode(events).alias("event"))
