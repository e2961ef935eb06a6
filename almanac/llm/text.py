"""Words of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``.  The
separators are ASCII, so words can be cut on UTF-8 bytes.  Everything works on
the buffers of an Arrow string column: no Python object is made per word.  A
null text counts as a text without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = "[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of 64-bit keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """Words of consecutive documents.  bounds[d]:bounds[d+1] are those of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        terms = self.data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(self.data)]
        np.cumsum(terms, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; the offsets start at 0, nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with about `most` bytes of text each; a longer document stands alone."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of a text column; with lower, A-Z count as a-z."""
    data, offsets = buffers(column)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | first[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | first[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, by position of the first; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
