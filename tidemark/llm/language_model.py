"""Stupid-backoff scores of documents under the word pairs of the whole corpus.

The score of a word after another is the pair's count over the first word's followers, if the corpus has the pair at least
``least`` times; else ``alpha`` times the word's share of all words. A text's first word gets its share. A document's score
is the mean logarithm over its words.

Counts stay in tables dealt by hash, and the documents' pairs are joined to them: pairs are dealt by their first word, which
brings a pair's count and its first word's together; words whose pair is too rare are dealt on by word to the word counts;
sums go back by document. Rows travel packed, the pairs of many documents to a row. Head words, each over 1 / ``head`` of all
words and so at most ``head``, would make large buckets: their counts and those of pairs of them are made first, combined
before the shuffle, and every task knows them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as kit
from tidemark.llm.scratch import Scratch, bucket_keys, partitions

_LOW48 = np.uint64((1 << 48) - 1)
_MARK = np.uint64(1 << 32)  # set in every word's hash, which so has 47 bits of its own
_NO_ID = -(1 << 63)
_FLUSH_WORDS = 700_000
_FLUSH_DOCS = 60_000  # documents of a flush have 16 bits; pieces of a batch have 30,000 rows at most
_BUCKET_WORDS = 8_000_000
_COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])
_PAIRS = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("firsts", pa.binary()), ("runs", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("words", pa.binary()), ("sums", pa.binary())])
#: Rows of four kinds: words to score (low, high, docs, and in sums the flushes with their counts), word counts (low, high and sums),
#: sums of a flush's documents (docs, sums), and a flush's documents themselves (ids, low with their words, sums).
_RARE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("flush", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary()), ("ids", pa.binary())])
_ASKED, _LONE, _COUNTED, _SUMS, _OWNERS = range(5)


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows and hashes of all words, in order."""
    data, bounds = kit.utf8(piece.column("text"))
    data = kit.lower_ascii(data)
    begin, end, first = kit.words(data, bounds)
    return np.repeat(np.arange(piece.num_rows), np.diff(first)), (kit.window_hash(kit.prefix_sums(data), begin, end) & _LOW48) | _MARK


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return kit.mix(first * np.uint64(0xD6E8FEB86659FD93) + second + np.uint64(1))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0

    def counts() -> pa.RecordBatch:
        word, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(times.astype(np.int64))], schema=_COUNTS)

    for batch in batches:
        for piece in kit.text_slices(batch, "text"):
            held.append(_words(piece)[1])
            n += len(held[-1])
            if n > 4 * _FLUSH_WORDS:
                yield counts()
                held, n = [], 0
    if n:
        yield counts()


def _among(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def _count_head_pairs(head: np.ndarray):
    """Counts of pairs of head words, by the pair's hash, and of the followers of each head word, by its own with the sign bit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                row, word = _words(piece)
                known, _ = _among(head, word)
                follows = row[1:] == row[:-1]
                both = known[1:] & known[:-1] & follows
                pairs = _pair(word[:-1][both], word[1:][both]) & np.uint64((1 << 63) - 1)
                firsts = word[:-1][known[:-1] & follows] | np.uint64(1 << 63)
                key, times = np.unique(np.concatenate([pairs, firsts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], schema=_COUNTS)

    return run


class _Head:
    """What every task knows: head words with their counts and followers, and the counts of pairs of head words."""

    def __init__(self, words: np.ndarray, times: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.words, self.times = words, times
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        found, at = _among(self.keys, words | np.uint64(1 << 63))
        self.followers = np.where(found, self.counts[at] if len(self.counts) else 0, 0)


def _deal_pairs(head: _Head, total: int, least: int, alpha: float, keys: list[int]):
    targets = np.array(keys, np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"docs": [], "words": [], "ids": [], "n": 0, "rows": 0, "flush": TaskContext.get().partitionId() << 32}

        def flush() -> Iterator[pa.RecordBatch]:
            doc, word = np.concatenate(state["docs"]), np.concatenate(state["words"])
            n_docs = state["rows"]
            number = state["flush"]
            state["flush"] += 1
            opening = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            known, at = _among(head.words, word)
            sums = np.zeros(n_docs)
            # Pairs of head words are known here.
            both = np.zeros(len(word), bool)
            if len(word):
                both[1:] = known[1:] & known[:-1] & ~opening[1:]
            places = np.flatnonzero(both)
            found, pair_at = _among(head.keys, _pair(word[places - 1], word[places]) & np.uint64((1 << 63) - 1))
            times = np.where(found, head.counts[pair_at] if len(head.counts) else 0, 0)
            share = np.log(head.times[at[places]] / total * alpha)
            hit = np.log(np.maximum(times, 1) / np.maximum(head.followers[at[places - 1]], 1))
            sums += np.bincount(doc[places], np.where(times >= least, hit, share), n_docs)
            # First words need their share only; head words among them have it.
            first = np.flatnonzero(opening & known)
            sums += np.bincount(doc[first], np.log(head.times[at[first]] / total), n_docs)
            rest = np.flatnonzero(~both & ~(opening & known))
            before = np.where(opening[rest], np.uint64(0), word[rest - 1]) if len(rest) else np.zeros(0, np.uint64)
            lone = opening[rest]
            # A pair goes where its first word goes, one of a head word by the whole pair, a first word by itself.
            by = np.where(lone | (~lone & known[rest - 1]), _pair(before, word[rest]), kit.mix(before))
            bucket = (by % np.uint64(len(targets))).astype(np.int64)
            before = np.where(lone, np.uint64(1 << 48), before)  # no word's hash
            order = np.lexsort((before, bucket))
            bucket, before, second, docs = bucket[order], before[order], word[rest][order], doc[rest][order]
            which, cuts = np.unique(bucket, return_index=True)
            rows = []
            for b, a, z in zip(which.tolist(), cuts, kit.ends(cuts, len(bucket)), strict=True):
                new = np.flatnonzero(np.concatenate([[True], before[a + 1 : z] != before[a : z - 1]]))
                runs = np.diff([*new, z - a]).astype(np.uint32)
                # A head word as second travels as its place, marked by 0 in front; other words have theirs.
                common, place = _among(head.words, second[a:z])
                high = np.where(common, 0, (second[a:z] >> np.uint64(32)) | np.uint64(1)).astype(np.uint16)
                low = np.where(common, place.astype(np.uint64), second[a:z] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(targets[b]), number, before[a:z][new].tobytes(), runs.tobytes(), low.tobytes(), high.tobytes(), docs[a:z].astype(np.uint16).tobytes(), None, None, None))
            words = np.bincount(doc, minlength=n_docs).astype(np.int64)
            rows.append((int(targets[number % len(targets)]), number, None, None, None, None, None, np.concatenate(state["ids"]).tobytes(), words.tobytes(), sums.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAIRS)], schema=_PAIRS)
            state.update(docs=[], words=[], ids=[], n=0, rows=0)

        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                if state["rows"] and (state["rows"] + piece.num_rows > _FLUSH_DOCS or state["n"] > _FLUSH_WORDS):
                    yield from flush()
                row, word = _words(piece)
                state["docs"].append(row + state["rows"])
                state["words"].append(word)
                state["ids"].append(piece.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64))
                state["n"] += len(word)
                state["rows"] += piece.num_rows
        if state["rows"]:
            yield from flush()

    return run


def _sum_rows(flush: np.ndarray, docs: np.ndarray, values: np.ndarray, flushes: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Sums by document of each flush: its number, the documents, the sums."""
    key = flush.astype(np.int64) << 16 | docs.astype(np.int64)
    unique, inverse = np.unique(key, return_inverse=True)
    sums = np.bincount(inverse, values, len(unique))
    owner = unique >> 16
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(unique) else np.zeros(0, np.int64)
    rows = []
    for a, z in zip(cuts, kit.ends(cuts, len(unique)), strict=True):
        rows.append((int(flushes[owner[a]]), (unique[a:z] & 0xFFFF).astype(np.uint16).tobytes(), sums[a:z].tobytes()))
    return rows


def _rare_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RARE)], schema=_RARE)


def _two(words: np.ndarray) -> tuple[bytes, bytes]:
    return words.astype(np.uint32).tobytes(), (words >> np.uint64(32)).astype(np.uint16).tobytes()


def _one(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)


def _sum_kind(sums: list[tuple[int, bytes, bytes]], targets: np.ndarray) -> list[tuple]:
    return [(int(targets[f % len(targets)]), _SUMS, f, None, None, d, s, None) for f, d, s in sums]


def _score_pairs(head: _Head, total: int, least: int, alpha: float, keys: list[int]):
    """A bucket's pairs: sums for those frequent enough, and the words of the others dealt by word. Owners pass through."""
    targets = np.array(keys, np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            owners = []
            for b, flush, *parts, ids, words, value in zip(*[batch.column(c).to_pylist() for c in _PAIRS.names], strict=True):
                if ids is None:
                    held.setdefault(b, []).append((flush, *parts))
                else:
                    owners.append((b, _OWNERS, flush, words, None, None, value, ids))
            yield _rare_batch(owners)
        for b in list(held):
            parts = held.pop(b)
            flushes = np.array([p[0] for p in parts], np.int64)
            first = np.concatenate([np.repeat(np.frombuffer(p[1], np.uint64), np.frombuffer(p[2], np.uint32)) for p in parts])
            low, high = (b"".join(p[i] for p in parts) for i in (3, 4))
            second = _one(low, high)
            common = np.frombuffer(high, np.uint16) == 0
            second[common] = head.words[np.frombuffer(low, np.uint32)[common]]
            docs = np.frombuffer(b"".join(p[5] for p in parts), np.uint16)
            flush = np.repeat(np.arange(len(parts)), [len(p[5]) // 2 for p in parts])
            del parts, low, high, common
            order = np.lexsort((second, first))
            first, second, docs, flush = first[order], second[order], docs[order], flush[order]
            new_first = np.concatenate([[True], first[1:] != first[:-1]])
            new_pair = new_first | np.concatenate([[True], second[1:] != second[:-1]])
            runs = lambda new: np.repeat(c := np.diff([*np.flatnonzero(new), len(new)]), c)
            followers, times = runs(new_first), runs(new_pair)
            headed, at = _among(head.words, first)
            followers = np.where(headed, head.followers[at] if len(head.words) else 0, followers)
            lone = first == np.uint64(1 << 48)
            hit = (times >= least) & ~lone
            value = np.log(times / np.maximum(followers, 1))
            known, at = _among(head.words, second)
            known &= ~hit
            value = np.where(known, np.log((head.times[at] if len(head.words) else np.ones(len(at))) / total * alpha), value)
            done = hit | known
            rows = _sum_kind(_sum_rows(flush[done], docs[done], value[done], flushes), targets)
            for kind, part in ((_ASKED, ~done & ~lone), (_LONE, ~done & lone)):
                word, which_flush, doc = second[part], flush[part], docs[part]
                bucket = (kit.mix(word) % np.uint64(len(targets))).astype(np.int64)
                order = np.lexsort((which_flush, bucket))
                word, which_flush, doc, bucket = word[order], which_flush[order], doc[order], bucket[order]
                which, cuts = np.unique(bucket, return_index=True)
                for t, a, z in zip(which.tolist(), cuts, kit.ends(cuts, len(bucket)), strict=True):
                    there, count = np.unique(which_flush[a:z], return_counts=True)
                    rows.append((int(targets[t]), kind, None, *_two(word[a:z]), doc[a:z].tobytes(), np.stack([flushes[there], count]).astype(np.int64).tobytes(), None))
            yield _rare_batch(rows)

    return run


def _score_words(total: int, alpha: float, keys: list[int]):
    """A bucket's word counts, and the words that are scored by them. Sums and owners pass through."""
    targets = np.array(keys, np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[tuple]]] = {}
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist(), np.int64)
            yield batch.filter(pa.array(kinds >= _SUMS))
            for b, kind, *parts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "low", "high", "docs", "sums")], strict=True):
                if kind < _SUMS:
                    held.setdefault(b, {}).setdefault(kind, []).append(tuple(parts))
        for b in list(held):
            kinds = held.pop(b)
            counted = kinds.get(_COUNTED, [])
            word = _one(*(b"".join(p[i] for p in counted) for i in (0, 1)))
            times = np.frombuffer(b"".join(p[3] for p in counted), np.int64)
            order = np.argsort(word)
            word, times = word[order], times[order]
            for kind, share in ((_ASKED, alpha), (_LONE, 1.0)):
                asked = kinds.get(kind)
                if not asked:
                    continue
                wanted = _one(*(b"".join(p[i] for p in asked) for i in (0, 1)))
                docs = np.frombuffer(b"".join(p[2] for p in asked), np.uint16)
                numbers = [np.frombuffer(p[3], np.int64).reshape(2, -1) for p in asked]
                flush = np.repeat(np.concatenate([n[0] for n in numbers]), np.concatenate([n[1] for n in numbers]))
                flushes, flush = np.unique(flush, return_inverse=True)
                value = np.log(times[np.searchsorted(word, wanted)] / total * share)
                yield _rare_batch(_sum_kind(_sum_rows(flush, docs, value, flushes), targets))

    return run


def _pack_counts(keys: list[int]):
    targets = np.array(keys, np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").to_numpy().view(np.uint64)
            n = batch.column("n").to_numpy()
            bucket = (kit.mix(word) % np.uint64(len(targets))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            which, cuts = np.unique(bucket[order], return_index=True)
            yield _rare_batch([(int(targets[t]), _COUNTED, None, *_two(word[order[a:z]]), None, n[order[a:z]].tobytes(), None) for t, a, z in zip(which.tolist(), cuts, kit.ends(cuts, len(order)), strict=True)])

    return run


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of whole flushes with all their sums."""
    ids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sums: dict[int, np.ndarray] = {}
    later: list[tuple[int, bytes, bytes]] = []
    for batch in batches:
        for flush, docs, who, words, value in zip(*[batch.column(c).to_pylist() for c in ("flush", "docs", "ids", "low", "sums")], strict=True):
            if who is not None:
                ids[flush] = np.frombuffer(who, np.int64), np.frombuffer(words, np.int64)
                sums[flush] = sums.get(flush, 0) + np.frombuffer(value, np.float64)
            else:
                later.append((flush, docs, value))
    for flush, docs, value in later:
        sums[flush] = sums[flush] + np.bincount(np.frombuffer(docs, np.uint16), np.frombuffer(value, np.float64), len(sums[flush]))
    for flush, (who, words) in ids.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(who, mask=who == _NO_ID), pa.array(words), pa.array(sums[flush] / np.maximum(words, 1), mask=words == 0)],
            ["doc_id", "n_words", "score"],
        )


def score(docs: DataFrame, least: int = 2, alpha: float = 0.4, head: int = 1000) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by the counts of all of them: doc_id, n_words, score.

    Words are runs without ASCII white space with A-Z in lower case, compared by 47-bit hashes beside their neighbour's. Null texts
    and those without words have n_words 0 and a null score; a null doc_id stays null; repeated rows are counted and scored each;
    other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language_model")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # As many buckets as keep each to so many words, however large the corpus is.
    keys = bucket_keys(spark, max(partitions(spark), -(-total // _BUCKET_WORDS)))
    n = len(keys)
    frequent = counts.where(F.col("n") * head > total).toPandas().sort_values("word")
    words, times = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    pairs = texts.mapInArrow(_count_head_pairs(words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    known = _Head(words, times, pairs["word"].to_numpy(np.int64).view(np.uint64), pairs["n"].to_numpy(np.int64))

    # One chain of shuffles without tables between, as the pairs are the bulk; what is done passes through what follows.
    rare = "bucket int, kind int, flush long, low binary, high binary, docs binary, sums binary, ids binary"
    dealt = texts.mapInArrow(_deal_pairs(known, total, least, alpha, keys), "bucket int, flush long, firsts binary, runs binary, low binary, high binary, docs binary, ids binary, words binary, sums binary")
    scored = dealt.repartition(n, "bucket").mapInArrow(_score_pairs(known, total, least, alpha, keys), rare)
    asked = scored.unionByName(counts.mapInArrow(_pack_counts(keys), rare))
    sums = asked.repartition(n, "bucket").mapInArrow(_score_words(total, alpha, keys), rare)
    return sums.select("flush", "docs", "ids", "low", "sums").repartition(n, "flush").mapInArrow(_gather, "doc_id long, n_words long, score double")
