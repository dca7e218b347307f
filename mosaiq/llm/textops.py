"""Vectorised text primitives over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 is
the same as ``[^\\x20\\x09-\\x0D]+`` on code points. All work is done on slices of
bounded size; one text longer than the bound forms a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 64  # prefix sums then fit tables of 2^20 powers

NONWS = np.ones(256, dtype=bool)
NONWS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

WORD = r"[^\x20\x09-\x0D]+"


_HELD: list[Callable[[], None]] = []


def hold(release: Callable[[], None]) -> None:
    """Name what frees a cache that a worker keeps from task to task."""
    _HELD.append(release)


def let_go() -> None:
    """Free what this worker keeps; executors run their workers for many tasks and operators."""
    for release in _HELD:
        release()


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's function that starts without what other operators kept, and leaves little behind.

    An idle worker's memory counts against its executor as long as the worker lives.
    """

    @functools.wraps(f)
    def run(it: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from f(it, *args, **options)
        finally:
            trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    step = np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * step) | np.uint64(1)


class Poly:
    """Polynomial hashes of substrings modulo 2^64, by prefix sums.

    Two objects with different salts use different bases and symbol values.
    """

    def __init__(self, salt: int):
        self.symbols = seeds(256, salt)
        self.base = int(seeds(1, salt + 101)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.clear()
        hold(self.clear)

    def clear(self) -> None:
        self._tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            m = 1 << max(16, (n - 1).bit_length())
            out = []
            for b in (self.base, self.inverse):
                t = np.full(m, b, dtype=np.uint64)
                t[0] = 1
                out.append(np.multiply.accumulate(t))
            if m > 4 * SLICE_BYTES:  # for one very long text: not kept
                return out[0], out[1]
            self._tables = (out[0], out[1])
        return self._tables

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * base^i, with a leading zero."""
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Finalised hashes of values[starts:ends], equal for equal contents."""
        _, down = self._powers(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * down[starts])

    def bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.symbols[data])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at, n = column.offset, len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay below ``limit``, or single longer rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = NONWS[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words at which a k-word window of one row starts, and the row of each."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return first[:-1][rows] + np.arange(len(rows)) - begin[rows], rows


def slice_rows(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    part = offsets[lo : hi + 1]
    return data[part[0] : part[-1]], part - part[0]


def coverage(positions: np.ndarray, width: int) -> np.ndarray:
    """Merged [start, end) intervals of ``width`` beginning at sorted distinct positions, as an (n, 2) array."""
    if not len(positions):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(positions) > width) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [len(positions) - 1]))
    return np.stack([positions[first], positions[last] + width], axis=1).astype(np.int64)
