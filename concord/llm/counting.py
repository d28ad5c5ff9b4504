"""Counts of hashed keys over a whole table, for tables of fixed size that say what is frequent.

A task sorts its keys and passes them on by range of the hash, as steps from one key to the next. Within a range 32 bits
are kept, so keys of different hashes may be counted as one: counts are upper bounds, and closer the more ranges there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concord.llm.registry import trimmed

INNER = 32
LEAST_RANGES = 64


def ranges_for(keys: int, per_range: int = 1 << 20, bits: int = 27) -> int:
    """Ranges, a power of two, so that each has about ``per_range`` keys and a whole byte of a table of ``bits`` bits."""
    return 1 << min(bits - 3, max(LEAST_RANGES.bit_length() - 1, int(np.ceil(np.log2(max(1, keys / per_range))))))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the high ones are nearly all zero, and shuffles pack them well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class Runs:
    """Keys of a task, added up in memory while that makes them fewer, and passed on as packed runs."""

    def __init__(self, ranges: int, held: int) -> None:
        self.bits, self.limit = ranges.bit_length() - 1, held
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(hashes >> np.uint64(64 - INNER - self.bits))
        self.n.append(np.ones(len(hashes), np.int64))
        self.size += len(hashes)
        if self.size >= self.limit:
            keys, n = _summed(np.concatenate(self.keys), np.concatenate(self.n))
            if len(keys) >= self.limit // 2:
                self.keys, self.n, self.size = [], [], 0
                yield self._packed(keys, n)
            else:
                self.keys, self.n, self.size = [keys], [n], len(keys)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self._packed(*_summed(np.concatenate(self.keys), np.concatenate(self.n)))

    def _packed(self, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        home = keys >> np.uint64(INNER)
        first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            local = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((int(home[a]), _planes(np.diff(local, prepend=np.uint32(0))), _planes(np.minimum(n[a:b], 0xFFFFFFFF))))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "steps", "n"])


def table_of(rows: DataFrame, spread: Callable, ranges: int, cells: int, cell: Callable[[np.ndarray], np.ndarray], bits: bool = False) -> np.ndarray:
    """A table of ``cells`` bytes over all hashes: each the largest ``cell(counts)`` of the keys that fall on it.

    ``spread`` is a function for ``mapInArrow`` that gives batches of ``Runs``. Each range is added up by one task. What
    the driver gets is the table, compressed. With ``bits`` cells are 0 or 1, and eight make a byte.
    """
    stretch = cells // ranges

    def gather(batches):
        now, held = None, []

        def done():
            keys = np.concatenate([np.cumsum(_of_planes(x), dtype=np.uint64) for x, _ in held])
            keys, n = _summed(keys, np.concatenate([_of_planes(x) for _, x in held]).astype(np.int64))
            own, values = np.zeros(stretch, np.uint8), cell(n)
            some = np.flatnonzero(values)
            np.maximum.at(own, (keys[some] >> np.uint64(INNER - stretch.bit_length() + 1)).astype(np.int64), values[some])
            own = np.packbits(own, bitorder="little") if bits else own
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["range", "cells"])

        for batch in batches:
            for r, steps, n in zip(batch.column("range").to_pylist(), batch.column("steps").to_pylist(), batch.column("n").to_pylist()):
                if r != now and held:
                    yield done()
                    held = []
                now = r
                held.append((steps, n))
        if held:
            yield done()

    runs = rows.mapInArrow(trimmed(spread), "range int, steps binary, n binary").repartitionById(ranges, "range").sortWithinPartitions("range")
    found = runs.mapInArrow(trimmed(gather), "range int, cells binary").toArrow()
    out = np.zeros((ranges, stretch // 8 if bits else stretch), np.uint8)
    for r, own in zip(found.column("range").to_pylist(), found.column("cells").to_pylist()):
        out[r] = np.frombuffer(zlib.decompress(own), np.uint8)
    return out.ravel()
