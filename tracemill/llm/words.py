"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Words and shingles are compared by 64-bit hashes: a
polynomial over random byte values, finished by a mixing step, so two different ones meet with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once, unless one text alone is longer.
SLICE_BYTES = 1 << 18

_ONE = np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that looks random; another one for each ``salt``."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_BYTE = mixed(np.arange(256, dtype=np.uint64), 7)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        for_all = np.full(n, _BASE, np.uint64)
        for_all[0] = 1
        _powers = np.cumprod(for_all, dtype=np.uint64)
        for_all[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.cumprod(for_all, dtype=np.uint64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): rows whose texts have at most ``limit`` bytes together, or one row."""
    data, offsets = texts(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of a slice: ``starts``, ``ends``, ``hashes``; those of text k are at ``bounds[k]`` to ``bounds[k + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> None:
        if fold:
            data = FOLD[data]
        inside = ~BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        left = np.zeros(len(data), bool)
        left[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~left | edge[:-1]))
        left[:] = False
        left[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~left | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashes(data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        k = 0
        while k < len(out):
            at = self.starts[k]
            end = max(k + 1, int(np.searchsorted(self.ends, at + 2 * SLICE_BYTES, "right")))
            part = data[at : self.ends[end - 1]]
            _grow(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _powers[: len(part)], out=sums[1:])
            starts, ends = self.starts[k:end] - at, self.ends[k:end] - at
            out[k:end] = mixed((sums[ends] - sums[starts]) * _inverses[starts], 1)
            k = end
        return out

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mixed(out, 2)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a text with fewer words has its whole sequence, one without words none."""
    if 0 < len(hashes) < size:
        return mixed(grams(hashes, len(hashes)), 10 + len(hashes))
    found = np.sort(grams(hashes, size))
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
