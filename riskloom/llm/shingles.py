"""Word shingles of texts as 64-bit hashes, straight from the bytes of an Arrow column.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; no byte of a longer UTF-8 character is one of
these. A word's hash is its polynomial modulo 2**64, taken from running sums over the whole buffer, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of ``size`` words per text; keeps its tables of powers between calls."""

    def __init__(self, size: int):
        self.size = size
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _reach(self, length: int) -> None:
        if len(self.powers) < length:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, _BASE)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, _INVERSE)]))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word of the texts ``data[offsets[i]:offsets[i + 1]]``, and the number of words of each."""
        n = len(data)
        self._reach(n + 1)
        letters = _FOLD[data]
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.diff(np.searchsorted(starts, offsets))

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct shingles of each text; a text of fewer words is one shingle, one without words has none."""
        if not len(data):
            yield from (np.zeros(0, np.uint64) for _ in offsets[1:])
            return
        hashes, counts = self.words(data, offsets)
        rolled = np.zeros(max(0, len(hashes) - self.size + 1), np.uint64)
        for k in range(self.size):
            rolled = mix(rolled + hashes[k : k + len(rolled)] + np.uint64(k + 1))
        stop = 0
        for count in counts:
            start, stop = stop, stop + count
            if count >= self.size:
                yield np.unique(rolled[start : stop - self.size + 1])
            elif count:
                short = np.zeros(1, np.uint64)
                for k in range(count):
                    short = mix(short + hashes[start + k] + np.uint64(k + 1))
                yield mix(short + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of a string column with their bytes and offsets, about ``limit`` bytes each; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="left"))
        stop = min(len(column), max(start + 1, stop))
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop
