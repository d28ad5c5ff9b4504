"""Compact arrays in memory-mapped files: packed integers and Elias-Fano sequences, read many places at a time."""

from __future__ import annotations

import json

import numpy as np

from concord.llm import store

MAGIC = b"BUNDLE1\n"
_U1 = np.uint64(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: The place of the k-th set bit of each byte value.
_SELECT = np.argsort(1 - _BYTE_BITS, axis=1, kind="stable").astype(np.int64)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Integers of ``bits`` bits, at most 63, one after another in 64-bit words."""
    n = len(values)
    words = np.zeros(n * bits // 64 + 2, np.uint64)
    if n and bits:
        at = np.arange(n, dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        runs = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        values = values.astype(np.uint64)
        words[word[runs]] += np.add.reduceat(values << off, runs)
        words[word[runs] + 1] += np.add.reduceat(values >> _U1 >> (np.uint64(63) - off), runs)
    return words


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.int64)
    place = at * bits
    word, off = place >> 6, (place & 63).astype(np.uint64)
    value = (words[word] >> off) | (words[word + 1] << (np.uint64(63) - off) << _U1)
    return (value & np.uint64((1 << bits) - 1)).astype(np.int64)


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A sequence that never falls, below ``universe``: low bits packed, high bits as gaps in unary."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) // 512 + 1) * 512 if n else 512, bool)
    bits[high] = True
    ones = bits.reshape(-1, 512).sum(1)
    return {
        "low": pack(values & np.uint64((1 << low) - 1), low), "high": np.packbits(bits, bitorder="little").view(np.uint64),
        "ones": np.cumsum(ones) - ones, "shape": np.array([n, low], np.int64),
    }


def elias_fano_at(ef: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The values at the places ``at``: a block by its count of ones, a word, a byte, a bit."""
    low = int(ef["shape"][1])
    if not len(at):
        return np.zeros(0, np.int64)
    q = np.arange(len(at))
    block = np.searchsorted(ef["ones"], at, "right") - 1
    rest = at - ef["ones"][block]
    words = ef["high"][(block * 8)[:, None] + np.arange(8)]
    upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
    word = (upto <= rest[:, None]).sum(1)
    rest = rest - np.where(word > 0, upto[q, word - 1], 0)
    bytes_ = np.ascontiguousarray(words[q, word]).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.int64)
    byte = (upto <= rest[:, None]).sum(1)
    rest = rest - np.where(byte > 0, upto[q, byte - 1], 0)
    place = block * 512 + word * 64 + byte * 8 + _SELECT[bytes_[q, byte], rest]
    return ((place - at) << low) | unpack(ef["low"], low, at)


def write_bundle(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file, each at a multiple of eight bytes."""
    parts, index, at = [], {}, 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        index[name] = [x.dtype.str, at, len(x)]
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    with store.writer(uri) as f:
        f.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for x in parts:
            f.write(x)


def read_bundle(uri: str) -> dict[str, np.ndarray]:
    raw = store.mapped(uri)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"not a bundle: {uri}")
    size = int.from_bytes(raw[8:16].tobytes(), "little")
    out = {}
    for name, (kind, at, n) in json.loads(raw[16 : 16 + size].tobytes()).items():
        kind = np.dtype(kind)
        out[name] = raw[16 + size + at : 16 + size + at + n * kind.itemsize].view(kind)
    return out
