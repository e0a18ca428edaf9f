"""Removal of repeated byte strings by longest-previous-factor arrays, over buckets of suffixes.

A string of 100 bytes repeats only where its anchor does: the 48 bytes of smallest hash in it. Each anchor owns the run of
strings that it is the anchor of, so suffixes are dealt by anchor and equal strings meet. Anchors that occur once drop out
after a count. For the others the bytes around them, the context, travel; equal contexts are combined before and after the
shuffle. What is left in a bucket is put in suffix order with the common prefixes of neighbours; the previous and the next
smaller place there give each suffix its longest previous factor, and a string goes where that has 100 bytes. Where an anchor
is very frequent its strings are dealt one by one instead, by their own bytes, and equal ones are combined as contexts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as kit
from tidemark.llm.scratch import Scratch, bucket_keys, partitions

LENGTH = 100
_ANCHOR = 48  # a multiple of 8; shorter ones repeat by chance in documents that share no whole string
_REACH = LENGTH - _ANCHOR + 1
_SEGMENT = 4 << 20
_PLACE_BITS = 24
_FLUSH = 24 << 20
_BATCH = 4 << 20  # bytes of places that are handed on at once
_BUCKET = 64 << 20  # bytes of text to a bucket
_LAST = (1 << 63) - 1  # stands for a null doc_id, which comes after all others

_ANCHORS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_LOTS = pa.schema([("lot", pa.int32()), ("docs", pa.binary()), ("places", pa.binary())])
_PLACES = pa.schema([("doc_id", pa.int64()), ("places", pa.binary())])
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("begins", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("spans", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - _ANCHOR + 1
    data = np.ascontiguousarray(data)
    total = np.zeros(n, np.uint64)
    for at in range(0, _ANCHOR, 8):
        part = np.ndarray((n,), np.uint64, data, at, (1,))
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + (part ^ (part >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return kit.mix(total)


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes, places, first owned string and number of owned strings of all anchors; places within the row's text."""
    parts = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), _SEGMENT):
        piece = data[begin : begin + _SEGMENT + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        hashes = _gram_hashes(piece)
        key = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= _REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < _REACH:
            key = np.minimum(key[: len(key) - (_REACH - width)], key[_REACH - width :])
        place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        start = np.arange(len(place)) + begin
        row = np.searchsorted(bounds, start, side="right") - 1
        whole = start + LENGTH <= bounds[row + 1]
        place, start, row = place[whole], start[whole], row[whole]
        if not len(place):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(row) != 0)]))
        count = np.diff([*new, len(place)])
        r = row[new]
        parts.append((r, hashes[place[new]], place[new] + begin - bounds[r], start[new] - bounds[r], count))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    which, cuts = np.unique(bucket[order], return_index=True)
    for b, a, z in zip(which.tolist(), cuts, kit.ends(cuts, len(order)), strict=True):
        yield b, order[a:z]


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, which a shuffle compresses better than the values; unsigned ones wrap."""
    return np.diff(values, prepend=values.dtype.type(0))


def _deal_anchors(keys: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                row, hashes, place, _, _ = anchors(*kit.utf8(piece.column("text")))
                docs = _ids(piece.column("doc_id"))[row]
                rows = [(keys[b], hashes[at], docs[at], place[at]) for b, at in _by_bucket((hashes % np.uint64(len(keys))).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, *_ in rows], pa.int32()),
                        pa.array([(h >> np.uint64(32)).astype(np.uint32).tobytes() for _, h, _, _ in rows], pa.binary()),
                        pa.array([_steps(d).tobytes() for _, _, d, _ in rows], pa.binary()),
                        pa.array([_steps(p.astype(np.uint32)).tobytes() for *_, p in rows], pa.binary()),
                    ],
                    schema=_ANCHORS,
                )

    return run


def _repeated_places(frequent: int, keys: list[int]):
    """Of one bucket's anchors those that occur more than once, dealt by document; the lowest bit says if an anchor is frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for b, *parts in zip(*[batch.column(c).to_pylist() for c in _ANCHORS.names], strict=True):
                held.setdefault(b, []).append(tuple(parts))
        for b in list(held):
            parts = held.pop(b)
            hashes = np.frombuffer(b"".join(p[0] for p in parts), np.uint32)
            docs, places = (np.concatenate([np.cumsum(np.frombuffer(p[i], t), dtype=t) for p in parts]) for i, t in ((1, np.int64), (2, np.uint32)))
            _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
            times = count[inverse]
            docs, places, times = docs[times > 1], places[times > 1], times[times > 1]
            marked = (places << np.uint32(1)) | (times > frequent).astype(np.uint32)
            order = np.lexsort((marked, docs))
            docs, marked = docs[order], marked[order]
            # A row for each lot of documents, not for each document, of which each bucket has parts.
            lot = (kit.mix(docs.astype(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
            rows = [(keys[n], _steps(docs[at]).tobytes(), marked[at].tobytes()) for n, at in _by_bucket(lot)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LOTS)], schema=_LOTS)

    return run


def _places_by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each document from all buckets' rows of its lot; a lot is in one task."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for n, *parts in zip(*[batch.column(c).to_pylist() for c in _LOTS.names], strict=True):
            held.setdefault(n, []).append(tuple(parts))
    for n in list(held):
        parts = held.pop(n)
        docs = np.concatenate([np.cumsum(np.frombuffer(d, np.int64), dtype=np.int64) for d, _ in parts])
        marked = np.concatenate([np.frombuffer(m, np.uint32) for _, m in parts])
        names, blobs, size = [], [], 0
        for doc, at in _by_bucket(docs):
            names.append(doc)
            blobs.append(marked[at].tobytes())
            size += len(blobs[-1])
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], schema=_PLACES)
                names, blobs, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], schema=_PLACES)


def _first_of_each(contexts: list[tuple[int, int, bytes, int, int]]) -> tuple[list[tuple[int, int, bytes, int, int]], list[tuple[int, int, int]]]:
    """Of (doc, begin, bytes, key, count) those that are first of their key and bytes, and what the others remove."""
    contexts.sort(key=lambda c: (c[0], c[1]))
    first: dict[tuple[int, bytes], tuple[int, int]] = {}
    kept, removed = [], []
    for c in contexts:
        doc, begin, data, key, count = c
        place = first.setdefault((key, data), (doc, begin))
        if place == (doc, begin):
            kept.append(c)
        else:
            removed.append((doc, begin, begin + count))
    return kept, removed


def _span_rows(removed: list[tuple[int, int, int]]) -> tuple[list[int], list[bytes]]:
    """Ranges of string starts by document, packed."""
    by_doc: dict[int, list[int]] = {}
    for doc, begin, end in removed:
        by_doc.setdefault(doc, []).extend((begin, end))
    return list(by_doc), [np.array(v, np.uint32).tobytes() for v in by_doc.values()]


def _deal_contexts(keys: list[int]):
    def flush(contexts: list[tuple[int, int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        kept, removed = _first_of_each(contexts)
        docs, spans = _span_rows(removed)
        none = lambda t: pa.nulls(len(docs), t)
        where = pa.array([keys[d % len(keys)] for d in docs], pa.int32())
        yield pa.RecordBatch.from_arrays([where, *[none(pa.binary())] * 5, pa.array(docs, pa.int64()), pa.array(spans, pa.binary())], schema=_CONTEXTS)
        dealt = np.array([c[3] for c in kept], np.uint64)
        for b, at in _by_bucket((dealt % np.uint64(len(keys))).astype(np.int64)):
            part = [kept[i] for i in at]
            packed = [np.array([c[j] for c in part], t).tobytes() for j, t in ((3, np.uint64), (0, np.int64), (1, np.uint32), (4, np.uint32))]
            row = [[keys[b]], *[[p] for p in packed], [b"".join(c[2] for c in part)], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _CONTEXTS, strict=True)], schema=_CONTEXTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[tuple[int, int, bytes, int, int]] = []
        size = 0
        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                data, bounds = kit.utf8(piece.column("text"))
                docs = _ids(piece.column("doc_id"))
                row, hashes, place, begin, count = anchors(data, bounds)
                whole = data.tobytes()
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
                for r, blob in enumerate(piece.column("places").to_pylist()):
                    marked = np.sort(np.frombuffer(blob, np.uint32))
                    at = np.arange(ends[r], ends[r + 1])
                    if not len(at) or not len(marked):
                        continue
                    known, here = marked >> np.uint32(1), place[at].astype(np.uint32)
                    seat = np.minimum(np.searchsorted(known, here), len(marked) - 1)
                    same = known[seat] == here
                    at, hot = at[same], (marked[seat[same]] & np.uint32(1)).astype(bool)
                    base, doc = int(bounds[r]), int(docs[r])
                    for h, b, n in zip(hashes[at[~hot]].tolist(), begin[at[~hot]].tolist(), count[at[~hot]].tolist(), strict=True):
                        contexts.append((doc, b, whole[base + b : base + b + n + LENGTH - 1], h, n))
                        size += n + LENGTH + 100
                    for b, n in zip(begin[at[hot]].tolist(), count[at[hot]].tolist(), strict=True):
                        sums = kit.prefix_sums(data[base + b : base + b + n + LENGTH - 1])
                        own = kit.window_hash(sums, np.arange(n), np.arange(n) + LENGTH).tolist()
                        contexts.extend((doc, b + i, whole[base + b + i : base + b + i + LENGTH], own[i], 1) for i in range(n))
                        size += n * (LENGTH + 100)
                    if size > _FLUSH:
                        yield from flush(contexts)
                        contexts, size = [], 0
        if contexts:
            yield from flush(contexts)

    return run


def _suffix_ranks(text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For widths of 8, 16 ... 128 bytes the rank of the string of that width at each place, by doubling; zeros follow the text."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    # Big-endian, so that numbers stand in the order of their bytes.
    rank = np.unique(np.ndarray((n,), np.uint64, padded, 0, (1,)).byteswap(), return_inverse=True)[1].astype(np.uint64)
    ranks, width = [(8, rank)], 8
    while width < LENGTH:
        later = np.zeros(n, np.uint64)
        later[: max(0, n - width)] = rank[width:] + np.uint64(1)
        rank = np.unique(rank * np.uint64(n + 2) + later, return_inverse=True)[1].astype(np.uint64)
        width *= 2
        ranks.append((width, rank))
    return ranks


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the suffix at each of ``starts`` the longest prefix, up to 128 bytes, that it shares with a suffix of smaller ``order``.

    In suffix order the suffixes of smaller order that share most are the nearest ones before and after: the previous and the
    next smaller entry. What they share is the least common prefix of neighbours on the way. Equal orders are one place, not an
    earlier one; the text counts as followed by zeros.
    """
    text = np.concatenate([text, np.zeros(136, np.uint8)])
    ranks = _suffix_ranks(text)
    # Ties of the whole width stand by order, so that the first of them leads.
    suffix = np.lexsort((order, ranks[-1][1][starts]))
    place, rank_in_text = order[suffix], starts[suffix]
    # Common prefixes of neighbours: from the widest strings that are equal on to narrower ones, then byte by byte.
    left, right = rank_in_text[:-1].copy(), rank_in_text[1:].copy()
    common = np.zeros(len(left), np.int64)
    for width, rank in reversed(ranks):
        same = rank[left] == rank[right]
        common, left, right = common + width * same, left + width * same, right + width * same
        wide = common >= 128
        left[wide] = right[wide] = 0
    going = common < 128
    for _ in range(7):
        going &= text[left] == text[right]
        common, left, right = common + going, left + going, right + going
    common = np.minimum(common, 128)

    def nearest_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
        """What each entry shares with the nearest one before it of smaller place: pointers jump along those found so far."""
        n = len(place)
        to, shared = np.arange(n) - 1, np.concatenate([[0], common])
        todo = np.flatnonzero(to >= 0)
        while len(todo):
            todo = todo[place[to[todo]] >= place[todo]]
            at = to[todo]
            shared[todo] = np.minimum(shared[todo], shared[at])
            to[todo] = to[at]
            todo = todo[to[todo] >= 0]
        return np.where(to >= 0, shared, 0)

    longest = np.maximum(nearest_smaller(place, common), nearest_smaller(place[::-1], common[::-1])[::-1])
    found = np.empty(len(starts), np.int64)
    found[suffix] = longest
    return found


def _remove_in_block(block: list[tuple[int, int, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """The string starts that repeat earlier among contexts of the same keys."""
    lengths = np.array([len(c[2]) for c in block])
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.array([c[4] for c in block])
    which = np.repeat(np.arange(len(block)), counts)
    within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    docs, begins = np.array([c[0] for c in block], np.int64)[which], np.array([c[1] for c in block], np.int64)[which] + within
    place = np.lexsort((begins, docs))
    rank = np.empty(len(which), np.int64)
    moved = np.concatenate([[True], (np.diff(docs[place]) != 0) | (np.diff(begins[place]) != 0)])
    rank[place] = np.cumsum(moved)
    longest = longest_previous_factors(np.frombuffer(b"".join(c[2] for c in block), np.uint8), offsets[which] + within, rank)
    found = np.flatnonzero(longest >= LENGTH)
    return [(d, b, b + 1) for d, b in zip(docs[found].tolist(), begins[found].tolist(), strict=True)]


def _factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        known = batch.column("spans").is_valid()  # what a task found alone passes through
        yield batch.select(["doc_id", "spans"]).filter(known)
        for b, *parts, doc in zip(*[batch.column(c).to_pylist() for c in (*_CONTEXTS.names[:6], "doc_id")], strict=True):
            if doc is None:
                held.setdefault(b, []).append(tuple(parts))
    for b in list(held):
        contexts = []
        for keys, docs, begins, counts, data in held.pop(b):
            at = 0
            for key, doc, begin, count in zip(*[np.frombuffer(x, t).tolist() for x, t in ((keys, np.uint64), (docs, np.int64), (begins, np.uint32), (counts, np.uint32))], strict=True):
                contexts.append((doc, begin, data[at : at + count + LENGTH - 1], key, count))
                at += count + LENGTH - 1
        kept, removed = _first_of_each(contexts)
        kept.sort(key=lambda c: c[3])
        block: list[tuple[int, int, bytes, int, int]] = []
        size, i = 0, 0
        while i < len(kept):
            j = i + 1
            while j < len(kept) and kept[j][3] == kept[i][3]:
                j += 1
            if j - i > 1:
                block.extend(kept[i:j])
                size += sum(len(c[2]) for c in kept[i:j])
            if size > 1 << 20:
                removed.extend(_remove_in_block(block))
                block, size = [], 0
            i = j
        if block:
            removed.extend(_remove_in_block(block))
        docs, spans = _span_rows(removed)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, pa.binary())], schema=_SPANS)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed bytes."""
    for batch in batches:
        ids, texts, spans = (batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))
        kept, n_removed, n_spans = [], [], []
        for text, parts in zip(texts, spans, strict=True):
            data = (text or "").encode()
            cover = np.zeros(len(data) + 1, np.int32)
            ranges = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
            np.add.at(cover, np.minimum(ranges[0::2], len(data)), 1)
            np.add.at(cover, np.minimum(ranges[1::2] + LENGTH - 1, len(data)), -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            n_removed.append(int(gone.sum()))
            n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "kept": kept, "n_removed": n_removed, "n_spans": n_spans}, schema=pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]))


def remove_repeats(docs: DataFrame, frequent: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Cut every byte covered by a 100-byte string that also starts earlier, in a smaller doc_id or earlier in the document.

    Returns two tables: for the documents that lose bytes doc_id, kept (binary), n_removed, n_spans; and for every row of ``docs``
    (doc_id, text) doc_id, n_bytes, sha256 of the whole text, and whether it is a later copy of an equal text, all of which is
    removed if it has 100 bytes. Strings are judged on the input. Null texts count as empty; a null doc_id comes after all
    others; rows that share doc_id and text stand at the same places and don't remove each other. Of several texts of one doc_id
    none is earlier than another: strings at equal places are one place, and each text loses what is found for any of them, so
    ids should be unique. ``frequent`` anchors are dealt string by string; results don't depend on it. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    whole = scratch.save(whole)
    keys = bucket_keys(spark, max(partitions(spark), -(-(whole.agg(F.sum("n_bytes")).first()[0] or 0) // _BUCKET)))
    buckets = len(keys)
    # Written first, so that the join's own shuffle can be split where one text is frequent.
    first = scratch.save(whole.groupBy("sha256").agg(F.min("doc_id").alias("first")))
    rows = scratch.save(whole.join(first, "sha256").select("doc_id", "n_bytes", "sha256", (F.col("doc_id") > F.col("first")).alias("copy")))

    dealt = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_deal_anchors(keys), "bucket int, hashes binary, docs binary, places binary")
    places = dealt.repartition(buckets, "bucket").mapInArrow(_repeated_places(frequent, keys), "lot int, docs binary, places binary")
    places = places.repartition(buckets, "lot").mapInArrow(_places_by_document, "doc_id long, places binary")
    places = places.join(rows.where("not copy").select("doc_id").distinct(), "doc_id", "left_semi")
    suspects = scratch.save(texts.join(places, "doc_id"))
    contexts = suspects.mapInArrow(_deal_contexts(keys), "bucket int, keys binary, docs binary, begins binary, counts binary, data binary, doc_id long, spans binary")
    spans = contexts.repartition(buckets, "bucket").mapInArrow(_factors, "doc_id long, spans binary")
    spans = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    cut = suspects.select("doc_id", "text").join(spans, "doc_id").dropDuplicates(["doc_id"])
    cut = cut.mapInArrow(_cut, "doc_id long, kept binary, n_removed long, n_spans long").where("n_removed > 0")
    return cut, rows


def digest(docs: DataFrame) -> DataFrame:
    cut, rows = remove_repeats(docs)
    cut = cut.select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    none = F.sha2(F.lit("").cast("binary"), 256)
    zero = F.lit(0).cast("long")
    return rows.join(cut, "doc_id", "left").select(
        F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
