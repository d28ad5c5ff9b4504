"""SentencePiece encoding and decoding: merges for all words of a slice at once, in rounds of numpy.

A text is cut wherever no piece of the vocabulary holds the two neighbouring characters, as no merge can cross
such a place; what lies between is a word. Equal words of a slice are merged once. Symbols of all words stand in
one flat array. In each round every word finds its least pair rank, all its pairs of that rank merge from left to
right, and the arrays are compacted; words without a pair are done.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from concord.llm import numtext
from concord.llm.registry import query, table

#: Fixed values of the model format: the mark of a space, types of pieces, the model type.
MARK = 0x2581
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

_NONE = np.int32(1 << 30)
_PAIR_BITS, _SIDE = 22, 1 << 21
#: Bytes of a text that is encoded part by part.
LONG = 1 << 22


# The model file


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """A byte-pair model as tables for arrays.

    Symbols are ids of pieces; a character that is no piece is the number of pieces plus its code point. Models
    that normalise by a character map, drop spaces, mark spaces at the end of words, have no byte pieces, or hold pieces
    of the user's own are refused.
    """

    def __init__(self, data: bytes) -> None:
        pieces, scores, kinds, trainer, normal = [], [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != BPE or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or not trainer.get(35):
            raise ValueError("only byte-pair models with byte pieces that keep texts as they are")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("models with pieces of the user's own or unused ones are not read")
        self.prefix = bool(normal.get(3, 1))
        self.size = len(pieces)
        self.bytes = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        own = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        number = lambda x: own[x] if x in own else self.size + ord(x)
        pairs = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in own or len(a) == 1) and (b in own or len(b) == 1):
                    pairs[number(a) * _SIDE + number(b)] = i
        self._pairs(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        order = sorted({-scores[i] for i in own.values()})
        self.rank = np.full(self.size + 1, _NONE, np.int32)  # the last is that of no pair
        place = {s: n for n, s in enumerate(order)}
        for i in own.values():
            self.rank[i] = place[-scores[i]]
        self.inside = np.zeros(1 << _PAIR_BITS, bool)
        two = np.array(sorted({(ord(p[j]), ord(p[j + 1])) for p in own for j in range(len(p) - 1)}), np.int64).reshape(-1, 2)
        self.inside[_slot(two[:, 0], two[:, 1])] = True

    def _pairs(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """A table of pairs by open addressing."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.keys, self.merged = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._place(keys[left], self.probes)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.merged[slot[put]] = keys[left[put]], merged[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64) + probe) & (len(self.keys) - 1)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = a.astype(np.int64) * _SIDE + b
        slot = self._place(keys, 0)
        found = self.keys[slot]
        out = np.where(found == keys, self.merged[slot], np.int32(-1))
        live = np.flatnonzero((found != keys) & (found != -1))
        for probe in range(1, self.probes):
            if not len(live):
                break
            slot = self._place(keys[live], probe)
            found = self.keys[slot]
            hit = found == keys[live]
            out[live[hit]] = self.merged[slot[hit]]
            live = live[~hit & (found != -1)]
        return out


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA6B) >> 7) & ((1 << _PAIR_BITS) - 1)


@lru_cache(maxsize=2)
def model(data: bytes) -> Model:
    return Model(data)


@lru_cache(maxsize=2)
def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


# Merge rounds


def merged(m: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word once no pair is left, and their numbers.

    One merge after another, least rank first and then leftmost, gives the same unless a merge makes a pair that ranks
    as low as those still to be merged in its round. Such words are found out, by the pairs of each new symbol with what
    stands before and after it at that time, and merge only their leftmost pair in that round.
    """
    kept_words, kept_sizes, kept_symbols = [], [], []
    word = np.arange(len(sizes))
    sizes = sizes.astype(np.int64)
    pair = np.full(len(symbols), -1, np.int32)
    if len(symbols) > 1:
        pair[:-1] = m.merge_of(symbols[:-1], symbols[1:])
    pair[np.cumsum(sizes) - 1] = -1
    while len(sizes):
        start = np.cumsum(sizes) - sizes
        rank = m.rank[pair]
        least = np.minimum.reduceat(rank, start)
        done = least == _NONE
        if done.any():
            out = np.repeat(done, sizes)
            kept_words.append(word[done])
            kept_sizes.append(sizes[done])
            kept_symbols.append(symbols[out])
            symbols, pair, rank = symbols[~out], pair[~out], rank[~out]
            word, sizes, least = word[~done], sizes[~done], least[~done]
            if not len(sizes):
                break
            start = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == least[of])
        new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        first = np.flatnonzero(new_run)
        at = at[(np.arange(len(at)) - first[np.cumsum(new_run) - 1]) % 2 == 0]
        at = at[_safe(m, symbols, pair, at, of, start, sizes, least)]
        own = of[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols[at] = pair[at]
        symbols, pair = symbols[keep], pair[keep]
        sizes = sizes - np.bincount(own, minlength=len(sizes))
        start = np.cumsum(sizes) - sizes
        at = at - np.arange(len(at))
        inner = at + 1 < (start + sizes)[own]
        pair[at] = -1
        right = at[inner]
        pair[right] = m.merge_of(symbols[right], symbols[right + 1])
        left = at[at > start[own]] - 1
        pair[left] = m.merge_of(symbols[left], symbols[left + 1])
    if not kept_words:
        return symbols, sizes
    word, sizes, symbols = np.concatenate(kept_words), np.concatenate(kept_sizes), np.concatenate(kept_symbols)
    order = np.argsort(word)
    return symbols[_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


def _safe(m: Model, symbols, pair, at, of, start, sizes, least) -> np.ndarray:
    """Which of the merges may be made in this round: all of a word, or its leftmost."""
    own, new = of[at], pair[at]
    again = np.flatnonzero(own[1:] == own[:-1])
    out = np.ones(len(at), bool)
    if not len(again):
        return out
    bad = np.zeros(len(sizes), bool)
    after = at + 2 < (start + sizes)[own]
    bad[own[after][m.rank[m.merge_of(new[after], symbols[at[after] + 2])] <= least[own[after]]]] = True
    before = at > start[own]
    last = symbols[np.maximum(at - 1, 0)]
    close = np.flatnonzero(np.concatenate([[False], (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])]))
    last[close] = new[close - 1]
    bad[own[before][m.rank[m.merge_of(last[before], new[before])] <= least[own[before]]]] = True
    out[again + 1] = ~bad[own[again + 1]]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after another."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


# Texts


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each row, and the offsets of rows among them."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[starts].astype(np.int32)
    out = first.copy()
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        b, at = first[wide], starts[wide]
        byte = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int32)
        two = ((b & 0x1F) << 6) | byte(1)
        three = ((b & 0x0F) << 12) | (byte(1) << 6) | byte(2)
        four = ((b & 0x07) << 18) | (byte(1) << 12) | (byte(2) << 6) | byte(3)
        out[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    return out, np.searchsorted(starts, offsets)


def _marked(m: Model, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spaces as marks, with one more before each text that is not empty."""
    chars = np.where(chars == 0x20, np.int32(MARK), chars)
    if not m.prefix:
        return chars, offsets
    some = np.diff(offsets) > 0
    upto = np.concatenate([[0], np.cumsum(some)])
    return np.insert(chars, offsets[:-1][some], MARK), offsets + upto


def _word_hashes(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    spread = numtext.mix(chars.astype(np.uint64) + np.uint64(1))
    place = np.arange(len(chars)) - np.repeat(starts, sizes)
    return numtext.mix(np.add.reduceat(spread * _odd(int(sizes.max()))[place], starts) + sizes.astype(np.uint64))


@lru_cache(maxsize=1)
def _odd_table(n: int) -> np.ndarray:
    return numtext.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def _odd(n: int) -> np.ndarray:
    return _odd_table(1 << max(10, (n - 1).bit_length()))


def encode_slice(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and the offsets of rows among them."""
    if len(offsets) == 2 and len(data) > LONG:
        ids = list(_in_parts(m, data))
        return np.concatenate(ids), np.array([0, sum(map(len, ids))])
    return _encode(m, *_marked(m, *code_points(data, offsets)))


def _in_parts(m: Model, data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text part by part; each ends where no merge can cross."""
    at, size = 0, LONG
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        part = data[at:end]
        chars, rows = code_points(part, np.array([0, len(part)]))
        if at == 0:
            chars, rows = _marked(m, chars, rows)
        else:
            chars = np.where(chars == 0x20, np.int32(MARK), chars)
        n = len(chars)
        if end < len(data):
            cuts = np.flatnonzero(~m.inside[_slot(chars[:-1], chars[1:])])
            if not len(cuts):
                size *= 2
                continue
            n = int(cuts[-1]) + 1
        starts = np.flatnonzero((part & 0xC0) != 0x80)
        text = n - (len(chars) - len(starts))  # without the mark before the text
        ids, _ = _encode(m, chars[:n], np.array([0, n]))
        yield ids
        at += int(starts[text]) if text < len(starts) else len(part)


def _encode(m: Model, chars: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    cut = np.ones(len(chars), bool)
    cut[1:] = ~m.inside[_slot(chars[:-1], chars[1:])]
    cut[rows[:-1][np.diff(rows) > 0]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(starts, append=len(chars))
    _, one, which = np.unique(_word_hashes(chars, starts, sizes), return_index=True, return_inverse=True)
    # words are the same only if all their characters are
    alike = sizes[one][which] == sizes
    odd = np.flatnonzero(~alike)
    at = _ranges(starts[alike], sizes[alike])
    differs = chars[_ranges(starts[one[which[alike]]], sizes[alike])] != chars[at]
    if differs.any():
        odd = np.union1d(odd, np.searchsorted(starts, at[differs], "right") - 1)
    if len(odd):
        which[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
    ids, n = merged(m, m.char[chars[_ranges(starts[one], sizes[one])]], sizes[one])
    ids, n = _with_bytes(m, ids, n)
    first = np.cumsum(n) - n
    out = ids[_ranges(first[which], n[which])]
    upto = np.concatenate([[0], np.cumsum(n[which])])
    return out, upto[np.searchsorted(starts, rows)]


def _with_bytes(m: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece, as the pieces of their bytes."""
    foreign = np.flatnonzero(symbols >= m.size)
    if not len(foreign):
        return symbols, sizes
    points = symbols[foreign] - m.size
    text = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    each = np.ones(len(symbols), np.int64)
    each[foreign] = width
    out = np.repeat(symbols, each)
    out[_ranges((np.cumsum(each) - each)[foreign], width)] = m.bytes[text]
    word = np.repeat(np.arange(len(sizes)), sizes)
    return out, sizes + np.bincount(word[foreign], weights=width - 1, minlength=len(sizes)).astype(np.int64)


# On Spark


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared(spark: SparkSession, path: str):
    """The model file, about half a megabyte, sent to the tasks once."""
    with open(path, "rb") as f:
        data = f.read()
    model(data)  # a file that can't be read is found out here
    return spark.sparkContext.broadcast(data)


def _own(docs: DataFrame, column: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c != column]


def _with_column(df: DataFrame, name: str, kind: DataType, values) -> DataFrame:
    """The rows with one more column, ``values(batch)``; a column of that name is replaced."""
    own = df.select(*_own(df, name))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in values(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])

    return own.mapInArrow(task, StructType([*own.schema.fields, StructField(name, kind)]))


def encoded(docs: DataFrame, model_file: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with ``ids``, the piece ids of the whole text without begin or end; a null text has none.

    Exactly what the sentencepiece library gives. Memory in a task follows slices of about a megabyte, or one text.
    """
    known = _shared(docs.sparkSession, model_file or default_model())
    source = docs.columns.index(text)
    own = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if i == source else F.col(f"`{c}`") for i, c in enumerate(docs.columns)])

    def values(batch):
        m = model(known.value)
        for a, b, data, offsets in numtext.slices(batch.column(text)):
            found, rows = encode_slice(m, data, offsets)
            yield batch.slice(a, b - a), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(found))

    return _with_column(own, ids, ArrayType(IntegerType()), values)


def decoded(rows: DataFrame, model_file: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with ``text``, what the library's decode makes of the ids; null ids give an empty text."""
    known = _shared(rows.sparkSession, model_file or default_model())

    def values(batch):
        library, column = _library(known.value), batch.column(ids)
        for a in range(0, len(batch), 256):
            texts = library.decode([x or [] for x in column.slice(a, 256).to_pylist()])
            yield batch.slice(a, 256), pa.array(texts, pa.string())

    return _with_column(rows, text, StringType(), values)


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` per row: encoded, and decoded from the ids again. Ids may be null or repeat."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return decoded(encoded(own, model_file).select("doc_id", "ids"), model_file)


def digests(rows: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))
