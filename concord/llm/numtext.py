"""Whole Arrow columns of text as numpy arrays: words, lines and their hashes.

Everything works on slices of about a megabyte, so memory in a task does not depend on the number
of rows in a batch; a longer document is a slice of its own and is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE, SLICE_ROWS = 1 << 20, 1 << 12
_SEGMENT = 1 << 22

#: The white space that separates words, 0x20 and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_MIXED = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, kept by the worker."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE + (1 << 12))
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; a null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary())
        values = values.fill_null(b"") if values.null_count else values
    else:
        values = values.cast(pa.large_string())
        values = values.fill_null("") if values.null_count else values
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(values: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, end row, bytes, offsets."""
    data, offsets = column(values)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), rows, first + SLICE_ROWS)
        lo, hi = offsets[first], offsets[end]
        yield first, end, data[lo:hi], offsets[first : end + 1] - lo
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of ``inside`` positions that stays within a row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~IS_SPACE[data], offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte ranges; ``lower`` takes A to Z as a to z."""
    out, table, first = np.empty(len(starts), np.uint64), _LOWER if lower else _TABLE, 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + _SEGMENT, "right")), first + 1)
        s, e = starts[first:last] - base, ends[first:last] - base
        power, inverse = _power_table(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(table[data[base : base + e[-1]]] * power[: e[-1]], out=total[1:])
        out[first:last] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _MIXED[63])
        first = last
    return out


def windows(values: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` values in a row, one after another, and the place of the first."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += values[i : i + n] * _MIXED[i]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(total[at]), at


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte value occurs in each row."""
    rows = len(offsets) - 1
    place = np.repeat(np.arange(rows, dtype=np.int64) << 8, np.diff(offsets))
    return np.bincount(place + data, minlength=rows << 8).reshape(rows, 256)


def row_salt(rows: int) -> np.ndarray:
    """A hash for each row, to keep equal values of different rows apart."""
    return mix(np.arange(1, rows + 1, dtype=np.uint64))
