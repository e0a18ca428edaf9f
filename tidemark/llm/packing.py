"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised and cut where Spark reads them. Each task packs its own pieces best-fit and emits the bins that
are nearly full; the underfull ones travel on as items of their fill, and tasks of ever fewer partitions pack those again.
Best fit leaves a task at most one bin that is half full or less, and two fuller ones can never meet in one. So only that one
and a bounded number of the emptiest others, which any such bin fits into if it fits anywhere, travel on; the rest are closed.
What reaches the last task is bounded by the fan-in, whatever the documents are.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch, partitions

_PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
_BIN = T.StructType([T.StructField("fill", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("pieces", T.ArrayType(_PIECE))])
_ARROW_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_ARROW_BIN = pa.schema([("fill", pa.int64()), ("done", pa.bool_()), ("pieces", pa.list_(_ARROW_PIECE))])


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with ids remembered word by word.

    The vocabulary's tokens never span white space or its word pattern, so a text's ids are those of its words joined.
    That holds for the characters in ``_PLAIN``; texts with others go through the tokenizer whole.
    """

    _PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ž]*")
    _WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    _REMEMBERED = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        """Encode unknown words in one text; each word's ids end with a token that ends words."""
        ids = self._encode(" ".join(new))
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) == len(new):
            data = ids.tobytes()
            self.known.update(zip(new, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        else:
            self.known.update((w, self._encode(w).tobytes()) for w in new)

    def many(self, texts: list[str]) -> list[bytes]:
        plain = [self._WORD.findall(t.lower()) if self._PLAIN.fullmatch(t) else None for t in texts]
        if len(self.known) > self._REMEMBERED:
            self.known.clear()
        new = set().union(*[p for p in plain if p]).difference(self.known)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) if p is not None else self._encode(t).tobytes() for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which runs many tasks and so keeps the words it has met."""
    return WordTokenizer(path)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item indices by bin, best-fit decreasing. Bins of equal room are interchangeable, so rooms are one bit mask."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins


def _placed(pieces: Iterable[tuple]) -> list[tuple]:
    """A bin's pieces, one after the other."""
    at, placed = 0, []
    for p in pieces:
        placed.append((*p[:5], at))
        at += p[3]
    return placed


def _bins(items: list[tuple[int, list]], capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    packed = best_fit([size for size, _ in items], capacity)
    fills = [sum(items[i][0] for i in b) for b in packed]
    done = [last or f >= capacity - slack for f in fills]
    for b in sorted((b for b in range(len(packed)) if not done[b] and 2 * fills[b] > capacity), key=fills.__getitem__)[_EMPTIEST:]:
        done[b] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(fills, pa.int64()), pa.array(done, pa.bool_()), pa.array([_placed(p for i in b for p in items[i][1]) for b in packed], pa.list_(_ARROW_PIECE))],
        schema=_ARROW_BIN,
    )


_ITEMS_AT_ONCE = 100_000
_EMPTIEST = 256  # bins over half full that travel on from a task's items


def _tokenise_and_pack(tokenizer_path: str, end_id: int, capacity: int, slack: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        items: list[tuple[int, list]] = []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for at in range(0, len(ids), 256):
                block = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for doc_id, data in zip(ids[at : at + 256], tokenizer.many(block), strict=True):
                    data += end
                    for piece, begin in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[begin : begin + 4 * capacity]
                        items.append((len(part) // 4, [(doc_id, piece, begin // 4, len(part) // 4, zlib.crc32(part), 0)]))
            if len(items) >= _ITEMS_AT_ONCE:
                yield _bins(items, capacity, slack, False)
                items = []
        if items:
            yield _bins(items, capacity, slack, False)

    return run


def _pack_again(capacity: int, slack: int, last: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list]] = []
        for batch in batches:
            rows = zip(batch.column("fill").to_pylist(), batch.column("pieces").to_pylist(), strict=True)
            items.extend((fill, [tuple(p.values()) for p in pieces]) for fill, pieces in rows)
            if len(items) >= _ITEMS_AT_ONCE:
                yield _bins(items, capacity, slack, last)
                items = []
        if items:
            yield _bins(items, capacity, slack, last)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, slack: int = 8, fan_in: int = 8) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its tokens and ``end_id``; only one longer than a sequence is cut, into full pieces and a rest. Null and
    empty texts are the lone ``end_id``; a null doc_id stays null; repeated rows are packed each; other columns are not read;
    an empty table gives no rows. Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Bins with at most ``slack`` free tokens are closed at once; ``fan_in`` partitions meet in one in each later round.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    level = scratch.save(rows.mapInArrow(_tokenise_and_pack(tokenizer_path, end_id, capacity, slack), _BIN))
    closed = [level.where("done")]
    width = partitions(spark)
    while True:
        width = -(-width // fan_in)
        packed = level.where(~F.col("done")).repartition(width).mapInArrow(_pack_again(capacity, slack, width == 1), _BIN)
        level = scratch.save(packed)
        closed.append(level.where("done"))
        if width == 1:
            break
    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    pieces = bins.select("sequence_id", F.explode("pieces").alias("x"))
    return pieces.select(*[f"x.{c}" for c in _PIECE.fieldNames()[:5]], "sequence_id", "x.offset")
