"""Vectorised byte and word arithmetic over Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes; its inverse modulo 2**64 turns prefix sums into window hashes.
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, _MULT, np.uint64)
            down = np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = _SLICE_BYTES, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` text bytes and ``rows`` rows, or one row where a text is longer."""
    if batch.num_rows == 0:
        return
    _, bounds = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), begin + rows, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, rows joined, and the rows' bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes, from which ``window_hash`` reads any window."""
    up, _ = _Powers.get(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.get(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs without ASCII white space, and for each row the index of its first word (plus the total)."""
    space = np.ones(len(data) + 1, bool)
    space[:-1] = _SPACE[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    word = ~space[:-1]
    starts = word.copy()
    starts[1:] &= space[:-2]
    starts[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= space[1:-1]
    if len(inner):
        ends[inner - 1] = word[inner - 1]
    begin = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, bounds)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of each k-word shingle; a row of fewer words has its whole sequence as its only shingle."""
    n = len(word_hash)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    acc = np.zeros(n, np.uint64)
    pad = np.concatenate([word_hash, np.zeros(k, np.uint64)])
    for j in range(k):
        acc = acc * np.uint64(_MULT) + pad[j : j + n] * np.uint64(2 * j + 3)
    inside = np.arange(n) + k <= np.repeat(first[1:], count)
    whole_rows, whole_hash = row[inside], mix(acc[inside])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            value = 0x51ED270B * int(count[r])
            for h in word_hash[first[r] : first[r + 1]]:
                value = (value * _MULT + int(h)) & 0xFFFFFFFFFFFFFFFF
            extra[i] = value
        whole_rows = np.concatenate([whole_rows, short])
        whole_hash = np.concatenate([whole_hash, mix(extra)])
    return whole_rows, whole_hash


def distinct_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in row and value order."""
    if not len(rows):
        return rows, values
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def ends(starts: np.ndarray, n: int) -> list[int]:
    """Where runs end that begin at ``starts`` and fill ``n`` places; nothing for no runs."""
    return [*starts[1:].tolist(), n] if len(starts) else []
