"""Vectorised word work on the buffers of an Arrow text column.

Texts are handled in slices of a few megabytes (one very long text is a slice of its own), so
memory follows the slice, not the batch. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes inside the ranges (both ends included)."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, and [^\x20\x09-\x0D]+. Both classes hold
# all of the bytes of non-ASCII characters or none, so they can be applied byte by byte.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Slice:
    """Some consecutive rows: ``data`` holds their bytes, row i is data[starts[i]:starts[i + 1]]."""

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray):
        self.first, self.data, self.starts = first, data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.starts[row] : self.starts[row + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Split a string column into slices of at most ``limit`` bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield Slice(row, raw[ends[row] : ends[last]], ends[row : last + 1] - ends[row])
        row = last


class Words:
    """Words of a slice: byte positions, and for each row the range of its words."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray):
        self.begin, self.end, self.offsets = begin, end, offsets

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(part: Slice, table: np.ndarray) -> Words:
    """Maximal runs of the bytes in ``table``; no run crosses a row."""
    size = len(part.data)
    inside = table[part.data]
    opens, closes = inside.copy(), inside.copy()
    if size:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        borders = part.starts[1:-1]
        borders = borders[(borders > 0) & (borders < size)]
        opens[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
    begin = np.flatnonzero(opens)
    return Words(begin, np.flatnonzero(closes) + 1, np.searchsorted(begin, part.starts))


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; kept and grown per process."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(part: Slice, found: Words, fold: bool = True) -> np.ndarray:
    """64-bit hash of every word's bytes, A-Z lower-cased; equal words hash alike everywhere."""
    values = _BYTE_VALUES[LOWER] if fold else _BYTE_VALUES
    prefix = np.zeros(len(part.data) + 1, dtype=np.uint64)
    np.cumsum(values[part.data] * powers(_MULTIPLIER, len(part.data)), out=prefix[1:])
    shift = powers(_INVERSE, len(part.data) + 1)[found.begin]
    return mix((prefix[found.end] - prefix[found.begin]) * shift + (found.end - found.begin).astype(np.uint64))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive words; entry i covers words i to i + length - 1."""
    count = max(0, len(hashes) - length + 1)
    total = np.zeros(count, dtype=np.uint64)
    for place in range(length):
        total *= np.uint64(_MULTIPLIER)
        total += hashes[place : place + count]
    return mix(total)


def window_rows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that stay inside their row, and the row of each."""
    row = np.repeat(np.arange(len(found.offsets) - 1), found.counts())
    count = max(0, len(row) - length + 1)
    whole = np.flatnonzero(row[:count] == row[length - 1 : length - 1 + count])
    return whole, row[whole]
