"""Vectorized kernels over batches of UTF-8 text, for use inside Arrow tasks.

Everything works on the bytes of a batch at once: no loop over words or characters. Texts
are taken in slices of a few megabytes, so the memory of a task does not grow with its
partition, only with its longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: White space that separates words: a blank and the five control characters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII characters but digits and letters separate words (after lower-casing A-Z).
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:0x80] = True
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: Byte to byte, A-Z lower-cased and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that each input bit reaches every output bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, count: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < count:
        size = 1 << max(16, (count - 1).bit_length())
        table = np.ones(size, np.uint64)
        table[1:] = base
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table[:count]


class Rolling:
    """Hashes of any byte ranges of a buffer, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * _power_table(_BASE, len(data)), out=self.sums[1:])
        self.back = _power_table(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more entry for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            begun = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begun + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and the first word of each text (and the end)."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ranges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each maximal run of marked bytes begins and ends; a run ends with its text."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    opens = inside & ~padded[:-2]
    closes = inside & ~padded[2:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes that are no separators."""
    if lower:
        data = LOWER[data]
    start, stop = ranges(~separators[data], offsets)
    return Words(start, stop, Rolling(data).of(start, stop), np.searchsorted(start, offsets))


def word_hash(word: str) -> np.uint64:
    """The hash that :func:`words` gives this (already lower-cased) word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return Rolling(data).of(np.array([0]), np.array([len(data)]))[0]


def chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbours: one for each of the first positions."""
    count = max(0, len(hashes) - length + 1)
    out = np.full(count, length, np.uint64)
    for step in range(length):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[step : step + count])
    return out


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run: ``runs([2, 3])`` is 0 1 0 1 2."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists with these numbers of entries."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
