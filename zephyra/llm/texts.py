"""Whole texts as numpy arrays, a bounded piece of a partition at a time.

Arrow hands a task its rows in batches. ``pieces`` cuts them so that one piece holds about ``PIECE_BYTES`` of text (a
longer text is a piece by itself, never cut), and shows the texts of a piece as one byte array with offsets. Null is the
empty text here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20
ROW_BYTES = 64

#: Odd multipliers for hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x94D049BB133111EB)

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

#: ASCII white space, the separators of ``bytes.split()``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A to Z become a to z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Piece:
    """Rows of one Arrow batch: ``rows`` (the batch), ``data`` (the bytes of all texts), ``bounds`` (a text's bytes are
    ``data[bounds[i]:bounds[i + 1]]``)."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def __len__(self) -> int:
        return self.rows.num_rows

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)


def views(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary array; null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else pa.large_string()
    array = array.cast(kind)
    if array.null_count:
        array = array.fill_null(b"" if kind == pa.large_binary() else "")
    _, bounds, data = array.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if bounds else np.zeros(1, np.int64)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[Piece]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = views(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield Piece(
                batch.slice(start, end - start), data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
            )
            start = end


def steady_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """``pieces`` whose cuts depend on the rows of the partition alone, not on how Arrow hands them over. A row counts as
    ``ROW_BYTES`` besides its text, so rows without text fill a piece too."""
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> Piece:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Piece(rows, *views(rows.column(column)))

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = views(batch.column(column))[1][1:] + ROW_BYTES * np.arange(1, batch.num_rows + 1)
        start = done = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, done + limit - size, side="right"))
            if stop <= start and not held:
                stop = start + 1  # a longer text is a piece by itself
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size, done, start = size + int(ends[stop - 1]) - done, int(ends[stop - 1]), stop
            if start < batch.num_rows:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def carried(columns: list[str]) -> Column:
    """Columns of any names as one struct, ``row``."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).alias("row")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2**64, for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        made = []
        for factor in (BASE, inverse):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(28))) * STEP
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` gives the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def words(data: np.ndarray, bounds: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which the table ``letter`` is true, within each text.

    Returns starts, ends, and ``first``: the words of text i are ``first[i]`` to ``first[i + 1]``.
    """
    inside = letter[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[bounds] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` neighbouring values; len(hashes) - n + 1 of them."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * STEP + hashes[k : k + count]
    return mixed(total + np.uint64(n))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.arange(int(lengths.sum()), dtype=np.int64)
    return out + np.repeat(np.asarray(starts, dtype=np.int64) - (np.cumsum(lengths) - lengths), lengths)
