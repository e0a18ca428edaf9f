"""Benchmark passages in documents by the q-gram lemma.

An item is cut into overlapping windows. If a window of n bytes occurs in a document with at most k edits, the two share at
least n + 1 - q - k * q q-grams whose diagonals (place in the document minus place in the window) lie within 2k + 1 of each
other. Shared q-grams are counted in bands of diagonals, each overlapping the next by half; bands that meet the bound are
verified by banded alignment. The items' index is the small side and has a size bound; more items are read in several parts, a
job for each, so that a plan has one Python stage however many they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as kit
from tidemark.llm.scratch import Scratch, bounded_batches

_NORMAL = kit.lower_ascii(np.arange(256, dtype=np.uint8))
_NORMAL[[9, 10, 11, 12, 13]] = 32
_Q, _SHORT_Q = 10, 8  # bytes of a q-gram; the latter for windows that with their edits are too short for the former
_LONG = 20
_BITS = 22


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the eight or ten bytes at each place."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = lambda at: np.ndarray((n,), np.uint64, data, at, (1,))
    if q == 8:
        return eight(0) * np.uint64(0x9E3779B97F4A7C15)
    return eight(0) * np.uint64(0x9E3779B97F4A7C15) + (eight(2) ^ (eight(2) >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Index:
    """Windows of the items with their edit budgets and least counts, and the places of each q-gram in them."""

    items: list[int]
    windows: list[bytes]
    budget: np.ndarray
    least: np.ndarray
    seen: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    q: int

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], window: int, rate: float, q: int) -> Index | None:
        items, windows = [], []
        for item, text in rows:
            text = _NORMAL[np.frombuffer(text, np.uint8)].tobytes()
            last = max(0, len(text) - window)
            for at in sorted({*range(0, last, max(1, window // 4)), last}):
                items.append(item)
                windows.append(text[at : at + window])
        if not windows:
            return None
        size = np.array([len(w) for w in windows])
        budget = (size * rate).astype(np.int64)
        least = size + 1 - q - budget * q
        if least.min() < 1:
            raise ValueError(f"windows of {size.min()} bytes don't allow {rate} edits a byte")
        codes = [_grams(np.frombuffer(w, np.uint8), q) for w in windows]
        window_of = np.repeat(np.arange(len(windows), dtype=np.int32), [len(c) for c in codes])
        place_of = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
        joined = np.concatenate(codes)
        order = np.argsort(joined, kind="stable")
        joined, window_of, place_of = joined[order], window_of[order], place_of[order]
        unique, begin, count = np.unique(joined, return_index=True, return_counts=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(unique)] = True
        return cls(items, windows, budget, least, seen, unique, begin, count, window_of, place_of, q)


def aligned(patterns: np.ndarray, texts: np.ndarray, first: np.ndarray, last: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignment of row pairs of ``patterns`` and ``texts``, of which the places ``first`` to ``last`` count.

    The patterns that occur with at most ``budget`` edits: their rows, begins and ends; of several occurrences the one with the
    fewest edits, leftmost end first. Only diagonals within the budget are kept, and pairs drop out once all of theirs cost more.
    """
    m, n = patterns.shape[1], texts.shape[1]
    width = n - m + 2 * budget + 1  # diagonals -budget .. n - m + budget
    rows = np.arange(len(patterns))
    if width <= 0 or not len(rows):
        return (np.zeros(0, np.int64),) * 3
    diagonal = np.arange(width, dtype=np.int32) - np.int32(budget)
    column = np.arange(width)
    far = np.int32(1_000_000)
    first, last = (x.astype(np.int32)[:, None] for x in (first, last))
    cost = np.where((diagonal >= first) & (diagonal <= last), np.int32(0), far)
    start = np.repeat(np.clip(diagonal, 0, n)[None, :], len(rows), 0)
    for i in range(1, m + 1):
        j = diagonal + np.int32(i)
        letter = texts[:, np.clip(j - 1, 0, n - 1)]
        across = np.where(j > first, cost + (letter != patterns[:, i - 1 : i]), far)
        down = np.full_like(cost, far)
        down[:, :-1] = cost[:, 1:] + 1
        take = down < across
        from_ = start.copy()
        from_[:, :-1] = np.where(take[:, :-1], start[:, 1:], start[:, :-1])
        # Insertions run to the right along the row: cost[d] = min over e <= d of best[e] + d - e.
        inside = (j >= first) & (j <= last)
        slid = np.where(inside, np.where(take, down, across), far) - diagonal
        running = np.minimum.accumulate(slid, axis=1)
        source = np.maximum.accumulate(np.where(slid == running, column, 0), axis=1)
        cost = np.where(inside, running + diagonal, far)
        start = np.take_along_axis(from_, source, 1)
        if i % 8 == 0 or i == m:
            near = cost.min(axis=1) <= budget
            if not near.all():
                rows, cost, start, patterns, texts, first, last = (x[near] for x in (rows, cost, start, patterns, texts, first, last))
                if not len(rows):
                    break
    best = np.argmin(cost, axis=1) if len(rows) else np.zeros(0, np.int64)
    return rows, start[np.arange(len(rows)), best].astype(np.int64), diagonal[best].astype(np.int64) + m


def within(pattern: bytes, text: bytes, budget: int) -> tuple[int, int] | None:
    """Where ``pattern`` occurs in ``text`` with at most ``budget`` edits (begin, end); None where it doesn't."""
    exact = text.find(pattern)
    if exact >= 0:
        return exact, exact + len(pattern)
    one = lambda b: np.frombuffer(b, np.uint8)[None, :]
    rows, begin, end = aligned(one(pattern), one(text), np.array([0]), np.array([len(text)]), budget)
    return (int(begin[0]), int(end[0])) if len(rows) else None


def _find(index: Index, data: np.ndarray, bounds: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
    """For each row with a verified window: item, begin and end in bytes."""
    found: dict[int, set[tuple[int, int, int]]] = {}
    codes = _grams(data, index.q)
    hit = np.flatnonzero(index.seen[_slot(codes)])
    if not len(hit):
        return found
    at = np.minimum(np.searchsorted(index.codes, codes[hit]), len(index.codes) - 1)
    same = index.codes[at] == codes[hit]
    hit, at = hit[same], at[same]
    row = np.searchsorted(bounds, hit, side="right") - 1
    inside = hit + index.q <= bounds[row + 1]
    hit, at, row = hit[inside], at[inside], row[inside]
    # Places that lie among enough others for any window at all.
    least = int(index.least.min())
    reach = max(len(w) for w in index.windows) + 2 * int(index.budget.max())
    if len(hit) < least:
        return found
    dense = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] <= reach)
    keep = np.zeros(len(hit) + 1, np.int64)
    np.add.at(keep, dense, 1)
    np.add.at(keep, dense + least, -1)
    kept = np.cumsum(keep[:-1]) > 0
    hit, at, row = hit[kept], at[kept], row[kept]
    if not len(hit):
        return found
    n = index.count[at]
    source = np.repeat(np.arange(len(hit)), n)
    entry = np.repeat(index.begin[at], n) + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    window, place = index.window_of[entry], index.place_of[entry]
    diagonal = hit[source] - place
    step = 2 * index.budget[window] + 1
    band = diagonal // step
    key_row = np.concatenate([row[source]] * 2)
    key_window = np.concatenate([window] * 2)
    key_band = np.concatenate([band, band - 1])
    order = np.lexsort((key_band, key_window, key_row))
    key_row, key_window, key_band = key_row[order], key_window[order], key_band[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(key_row) != 0) | (np.diff(key_window) != 0) | (np.diff(key_band) != 0)]))
    count = np.diff([*new, len(key_row)])
    enough = new[count >= index.least[key_window[new]]]
    # The bands that hold enough, by length and budget of their windows: exact occurrences first, the others by alignment.
    asked: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    whole = data.tobytes()
    for r, w, b in zip(key_row[enough].tolist(), key_window[enough].tolist(), key_band[enough].tolist(), strict=True):
        k, m = int(index.budget[w]), len(index.windows[w])
        begin, end = b * (2 * k + 1) - k, (b + 2) * (2 * k + 1) + m + k
        at = whole.find(index.windows[w], max(int(bounds[r]), begin), min(int(bounds[r + 1]), end))
        if at >= 0:
            found.setdefault(r, set()).add((index.items[w], at - int(bounds[r]), at - int(bounds[r]) + m))
        elif k:
            asked.setdefault((m, k), []).append((r, w, begin))
    for (m, k), these in asked.items():
        r, w, begin = (np.array(x, np.int64) for x in zip(*these, strict=True))
        n = 2 * (2 * k + 1) + m + 2 * k
        place = begin[:, None] + np.arange(n)
        patterns = np.frombuffer(b"".join(index.windows[x] for x in w.tolist()), np.uint8).reshape(-1, m)
        rows, start, end = aligned(patterns, data[np.clip(place, 0, len(data) - 1)], np.clip(bounds[r] - begin, 0, n), np.clip(bounds[r + 1] - begin, 0, n), k)
        for x, a, z in zip(rows.tolist(), start.tolist(), end.tolist(), strict=True):
            base = int(begin[x] - bounds[r[x]])
            found.setdefault(int(r[x]), set()).add((index.items[w[x]], base + a, base + z))
    return found


@dataclass
class Short:
    """Items too short for windows, by their number of bytes: codes in order, with the items of each code."""

    codes: dict[int, np.ndarray]
    items: dict[bytes, list[int]]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]]) -> Short:
        items: dict[bytes, list[int]] = {}
        for item, text in rows:
            items.setdefault(_NORMAL[np.frombuffer(text, np.uint8)].tobytes(), []).append(item)
        codes: dict[int, list[int]] = {}
        for text in items:
            data = np.frombuffer(text, np.uint8)
            codes.setdefault(len(text), []).append(kit.window_hash(kit.prefix_sums(data), np.array([0]), np.array([len(text)]))[0])
        return cls({n: np.unique(np.array(c, np.uint64)) for n, c in codes.items()}, items)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _find_short(short: Short, data: np.ndarray, bounds: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
    """For each row with a short item as whole words: item, begin and end in bytes."""
    found: dict[int, set[tuple[int, int, int]]] = {}
    inner = np.zeros(len(data) + 1, bool)  # places between two letters
    inner[1:-1] = _WORD[data[1:]] & _WORD[data[:-1]]
    inner[bounds] = False
    edges = np.flatnonzero(~inner)
    sums = kit.prefix_sums(data)
    for n, codes in short.codes.items():
        begin = edges[edges + n <= len(data)]
        begin = begin[~inner[begin + n]]
        begin = begin[np.isin(kit.window_hash(sums, begin, begin + n), codes)]
        for at, r in zip(begin.tolist(), (np.searchsorted(bounds, begin, side="right") - 1).tolist(), strict=True):
            if at + n <= bounds[r + 1]:
                for item in short.items.get(data[at : at + n].tobytes(), ()):
                    found.setdefault(r, set()).add((item, at - int(bounds[r]), at - int(bounds[r]) + n))
    return found


@dataclass
class Part:
    """Some of the items: those of no edits as whole texts, and two indexes by their q."""

    short: Short
    indexes: list[Index]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], window: int, rate: float) -> Part:
        exact = lambda text: int(len(text) * rate) == 0
        kinds = [(_SHORT_Q, lambda n: n < _LONG), (_Q, lambda n: n >= _LONG)]
        made = [Index.of([(i, t) for i, t in rows if not exact(t) and of(len(t))], window, rate, q) for q, of in kinds]
        return cls(Short.of([(i, t) for i, t in rows if exact(t)]), [index for index in made if index])

    def find(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
        found = _find_short(self.short, data, bounds) if self.short.items else {}
        for index in self.indexes:
            for row, hits in _find(index, data, bounds).items():
                found.setdefault(row, set()).update(hits)
        return found


def _hits(part: Part | None, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[int, set[tuple[int, int, int]]]]]:
    for piece in kit.text_slices(batch, "text"):
        data, bounds = kit.utf8(piece.column("text"))
        yield piece, part.find(_NORMAL[data], bounds) if part else {}


_PLACE = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
_KIND = "array<struct<item_id: bigint, begin: bigint, end: bigint>>"


def _scan(part: Part | None, ident: str):
    """Rows (ident, text) as (ident, hits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, found in _hits(part, batch):
                hits = [[{"item_id": i, "begin": a, "end": b} for i, a, b in sorted(found.get(r, ()))] for r in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column(ident), pa.array(hits, _PLACE)], [ident, "hits"])

    return run


def _clean(part: Part | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, found in _hits(part, batch):
                yield piece.filter(pa.array([r not in found for r in range(piece.num_rows)], pa.bool_()))

    return run


def _parts(items: DataFrame, window: int, rate: float, most_bytes: int) -> Iterator[Part]:
    """The items in parts of at most ``most_bytes`` of text each, or one longer item; the driver holds one part at a time."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0)).dropDuplicates(["item_id", "text"])
    part: list[tuple[int, bytes]] = []
    held = 0
    for r in known.orderBy("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        if held + len(text) > most_bytes and part:
            yield Part.of(part, window, rate)
            part, held = [], 0
        part.append((r["item_id"], text))
        held += len(text)
    if part:
        yield Part.of(part, window, rate)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` written once, with a number for each row that all later reads see alike."""
    return scratch.save(docs.withColumn("_number", F.monotonically_increasing_id()))


def _hits_by_number(numbered: DataFrame, parts: Iterable[Part], scratch: Scratch) -> DataFrame:
    """(_number, hits) of the rows with any: a job and a small table for each part."""
    texts, found = numbered.select("_number", "text"), None
    for part in parts:
        made = scratch.save(texts.mapInArrow(_scan(part, "_number"), f"_number long, hits {_KIND}").where(F.size("hits") > 0))
        found = made if found is None else found.union(made)
    return found.groupBy("_number").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 64, rate: float = 0.065, most_bytes: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find`` finds nothing; null and empty texts stay."""
    bounded_batches(docs.sparkSession)
    parts = _parts(items, window, rate, most_bytes)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return docs.mapInArrow(_clean(first), docs.schema)
    scratch = Scratch(docs.sparkSession, "decontamination")
    numbered = _numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text")), scratch)
    found = _hits_by_number(numbered, itertools.chain([first, second], parts), scratch)
    kept = numbered.join(found.select("_number"), "_number", "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def find(docs: DataFrame, items: DataFrame, window: int = 64, rate: float = 0.065, most_bytes: int = 1 << 20) -> DataFrame:
    """The windows of benchmark ``items`` (item_id, text) that occur in ``docs`` (doc_id, text) within their edit budget.

    Texts are compared as UTF-8 bytes with A-Z in lower case and white space as blanks; a window of n bytes may have ``rate`` * n
    edits, rounded down, whatever its length. Windows begin every quarter of ``window``, so an exact excerpt of a window and a
    quarter is always found; a shorter item is one window. Where that allows no edit, under 16 bytes, an item must stand there as
    whole words, or it would be found within others. Null and blank items are left out. Returns a row for each row of ``docs``:
    doc_id and hits, an array of (item_id, begin, end) by bytes of the text, empty for null and empty texts. Repeated rows are
    scanned each; other columns are not read. ``most_bytes`` of item text are looked for at once, more in further jobs.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = _parts(items, window, rate, most_bytes)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return rows.mapInArrow(_scan(first, "doc_id"), f"doc_id long, hits {_KIND}")
    scratch = Scratch(docs.sparkSession, "decontamination")
    numbered = _numbered(rows, scratch)
    found = _hits_by_number(numbered, itertools.chain([first, second], parts), scratch)
    return numbered.join(found, "_number", "left").select("doc_id", F.coalesce("hits", F.expr(f"cast(array() as {_KIND})")).alias("hits"))
