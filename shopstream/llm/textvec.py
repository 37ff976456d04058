"""Vectorised word work on Arrow string columns, shared by the operators that run inside tasks.

Everything here works on one bounded slice of rows at a time: `slices` cuts an Arrow batch so that a
slice holds at most `max_bytes` of text (one row at least), which bounds the numpy buffers whatever
the length of single texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1_000_000


def release() -> None:
    """Gives freed memory back to the system: worker processes live on between tasks and operators. Called after each Arrow batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: all but ASCII white space, or ASCII letters and digits and all of non-ASCII.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"n": 0, "up": powers(BASE, 0), "down": powers(BASE_INVERSE, 0)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > max(_POWERS["n"], SLICE_BYTES * 4):  # one huge text: not kept
        return powers(BASE, n), powers(BASE_INVERSE, n)
    if n > _POWERS["n"]:
        _POWERS.update(n=n, up=powers(BASE, n), down=powers(BASE_INVERSE, n))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) whose text is at most max_bytes, or a single row that is longer."""
    _, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray  # bytes, A-Z in lower case
    offsets: np.ndarray  # of rows in data
    start: np.ndarray  # of words in data
    end: np.ndarray
    first: np.ndarray  # of each row: the index of its first word (rows + 1)

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word; equal words have equal hashes in every task."""
        if not len(self.data):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """Words of every row: runs of bytes marked in `table`. No word crosses two rows."""
    data, offsets = buffers(column)
    if lower:
        data = _LOWER[data]
    inside = table[data]
    n = len(data)
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and their row offsets; a row of fewer words has one of all of them, a row without words none."""
    h = w.hashes()
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    out = np.zeros(first[-1], np.uint64)
    factors = powers(0xD1342543DE82EF95, size + 1)[1:]
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(w.first[:-1], n)
    length = np.repeat(np.minimum(counts, size), n)
    for k in range(size):
        inside = length > k
        if inside.all():
            out += h[at + k] * factors[k]
        else:
            out[inside] += h[at[inside] + k] * factors[k]
    return mix(out + length.astype(np.uint64)), first
