"""Token ids on disk: canonical length-limited Huffman codes from global counts, in independent blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm import numtext, store
from concord.llm.registry import query, small_batches, table, trimmed
from concord.session import materialise, scratch_path

#: Fixed values of the file format.
MAGIC = b"HUFIDS1\n"
BLOCK = 1024
LONGEST = 16

#: Bytes that a generation of the piece cache may take, with what Python adds to an entry.
_CACHED, _ENTRY = 16 << 20, 200
_known: dict[str, tuple[dict[int, bytes], dict[int, bytes]]] = {}
_held: dict[str, int] = {}
_ONE_RUN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


# Tokenizing


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before = rules.get("pre_tokenizer") or {}
    by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer")
    added = rules.get("added_tokens", ())
    by_word = by_word and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
    marks = _MARK.copy()
    marks[list({b for x in added for b in x["content"].encode()})] = False
    return Tokenizer.from_file(path), bool(by_word), marks


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _encode_new(tokenizer, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece; a run of letters is one unit to the pattern, and goes to the merges directly.

    The runs are turned into the tokenizer's letters all at once; none holds a line break, which parts them.
    """
    out, tokenize = [b""] * len(pieces), tokenizer.model.tokenize
    one_run = [_ONE_RUN.fullmatch(x) is not None for x in pieces]
    runs = [i for i, is_run in enumerate(one_run) if is_run]
    other = [i for i, is_run in enumerate(one_run) if not is_run]
    letters = b"\n".join([pieces[i] for i in runs]).decode("latin-1").translate(_LETTERS).split(_LETTERS[10])
    for i, x in zip(runs, letters):
        out[i] = array("I", [t.id for t in tokenize(x)]).tobytes()
    for i, e in zip(other, tokenizer.encode_batch([pieces[i].decode() for i in other], add_special_tokens=False)):
        out[i] = np.array(e.ids, np.uint32).tobytes()
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Starts of stretches that a byte-level tokenizer encodes independently of what is around them.

    Its pattern always breaks before a space between two characters that are not white space, and before an
    ASCII mark that follows a letter, but for apostrophes and what occurs in added tokens. Where a neighbour may be white space or a mark
    outside ASCII, the stretch simply goes on.
    """
    marks = np.flatnonzero(mark[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
    last = data[marks - 1]
    latin = (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7) & (data[np.maximum(marks - 2, 0)] == 0xC3) & (marks > 1)
    marks = marks[_LETTER[last] | latin]
    at = np.flatnonzero(data == 0x20)
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False
    inner[np.maximum(offsets[1:] - 1, 0)] = False
    at = at[inner[at]]
    before, after = data[at - 1], data[at + 1]
    odd = np.zeros(256, bool)
    odd[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
    wide = (before >= 0x80) & ((data[np.maximum(at - 2, 0)] == 0xC2) | odd[data[np.maximum(at - 3, 0)]])
    at = at[(before > 0x20) & (before != 0x7F) & ~wide & (after > 0x20) & (after != 0x7F) & ~odd[after]]
    edge = np.zeros(len(data) + 1, bool)
    for x in (at, marks, offsets[:-1][np.diff(offsets) > 0]):
        edge[x] = True
    return np.flatnonzero(edge)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def _ids_of(path: str, tokenizer, keys: list[int], pieces) -> list[bytes]:
    """Ids by the hash of a piece. The worker keeps those of late: two generations of bounded size."""
    new, old = _known.setdefault(path, ({}, {}))
    parts = [new.get(k) or old.get(k) for k in keys]
    fresh = [i for i, x in enumerate(parts) if x is None]
    for i, ids in zip(fresh, _encode_new(tokenizer, pieces(fresh))):
        parts[i] = ids
    size = sum(map(len, parts)) + _ENTRY * len(parts)
    if _held.get(path, 0) + size > _CACHED:
        new, old = {}, new
        _known[path], _held[path] = (new, old), 0
    if size <= _CACHED:
        new.update(zip(keys, parts))
        _held[path] = _held.get(path, 0) + size
    return parts


def encode_slice(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and the number of ids of each row."""
    tokenizer, by_word, marks = _tokenizer(path)
    rows = len(offsets) - 1
    if not by_word:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        ids = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.array([i for x in ids for i in x], np.uint32), counts
    starts = _pieces(data, offsets, marks)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
    ends = np.append(starts[1:], len(data))
    kinds, first, which = np.unique(numtext.hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    cut = lambda some: [raw[a:b] for a, b in zip(starts[first[some]].tolist(), ends[first[some]].tolist())]
    parts = _ids_of(path, tokenizer, kinds.tolist(), cut)
    flat = np.frombuffer(b"".join(parts), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    places = np.cumsum(lengths) - lengths
    each = lengths[which]
    upto = np.cumsum(each)
    ids = flat[np.repeat(places[which] - (upto - each), each) + np.arange(upto[-1])]
    row = np.searchsorted(offsets, starts, "right") - 1
    return ids, np.bincount(row, each, rows).astype(np.int64)


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids`` per row; ``ids`` is packed by zstandard until the counts are known.

    A null or empty text has the end id alone. Other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, data, offsets in numtext.slices(batch.column("text")):
                ids, counts = encode_slice(tokenizer, data, offsets)
                upto, blobs, sums = np.concatenate([[0], np.cumsum(counts)]), [], []
                for i in range(b - a):
                    own = np.append(ids[upto[i] : upto[i + 1]], np.uint32(end_id)).astype("<u4")
                    sums.append(zlib.crc32(own.tobytes()))
                    blobs.append(packer.compress(own.astype("<u2").tobytes() if narrow else own.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts + 1), pa.array(sums, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    narrow = _narrow(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(task), "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def _narrow(tokenizer: str) -> bool:
    return _tokenizer(tokenizer)[0].get_vocab_size() <= 1 << 16


def _unpack(blob: bytes, n: int, narrow: bool) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=4 * n)
    return np.frombuffer(raw, "<u2" if narrow else "<u4")


# The code


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    n, out = len(used), np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, levels = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        levels.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths: shorter first, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        size = int(lengths[i])
        code <<= size - last
        codes[i], last = code, size
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids``, and the bit at which every block of ids begins."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        runs = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[runs]] += np.add.reduceat(shifted >> np.uint64(32), runs)
        words[word[runs] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), runs)
    return words.astype(">u4").tobytes(), at[::BLOCK]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length of the code that each run of ``width`` bits begins with."""
    width = max(1, int(lengths.max(initial=0)))
    ids, sizes = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = (1 << (width - lengths[order].astype(np.int64))).astype(np.int64)
    upto = int(span.sum())
    ids[:upto], sizes[:upto] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes, width


def unpack(payload: np.ndarray, starts: np.ndarray, n: int, tables) -> np.ndarray:
    """The ``n`` ids of a bit string: all blocks advance together, an id of each at a time."""
    ids, sizes, width = tables
    out = np.zeros((len(starts), BLOCK), np.uint32)
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    at, short = starts.astype(np.int64).copy(), n - (len(starts) - 1) * BLOCK
    mask = np.uint64((1 << width) - 1)
    for i in range(min(BLOCK, n)):
        live = len(starts) if i < short else len(starts) - 1
        if not live:
            break
        p = at[:live]
        word = p >> 5
        two = (words[word] << np.uint64(32)) | words[word + 1]
        key = (two >> (64 - width - (p & 31)).astype(np.uint64)) & mask
        out[:live, i] = ids[key]
        at[:live] = p + sizes[key]
    return out.reshape(-1)[:n]


# Files


def _file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    present = np.array([x is not None for x in doc_ids], np.uint8)
    own = np.array([0 if x is None else x for x in doc_ids], "<i8")
    used = np.flatnonzero(lengths).astype("<u4")
    parts, starts, bits = [], [], 0
    for a in range(0, len(ids), BLOCK << 9):
        part, begin = pack(ids[a : a + (BLOCK << 9)], codes, lengths)
        starts.append(begin + bits)
        parts.append(part)
        bits += len(part) * 8
    starts = np.concatenate(starts).astype("<u8") if starts else np.zeros(0, "<u8")
    head = struct.pack("<5Q", len(own), len(ids), len(used), len(starts), bits // 8)
    return b"".join([MAGIC, head, used.tobytes(), lengths[used].tobytes(), present.tobytes(), own.tobytes(), counts.astype("<u4").tobytes(), starts.tobytes(), *parts])


class Ids:
    """A file of ids; blocks and documents are read on their own."""

    def __init__(self, uri: str):
        raw = store.mapped(uri)
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a file of ids: {uri}")
        n_docs, self.n_ids, n_used, n_blocks, n_bytes = struct.unpack("<5Q", raw[8:48].tobytes())
        at = 48

        def take(kind, n):
            nonlocal at
            size = np.dtype(kind).itemsize * n
            got = np.frombuffer(raw[at : at + size].tobytes(), kind)
            at += size
            return got

        used, sizes = take("<u4", n_used), take("u1", n_used)
        lengths = np.zeros(int(used.max(initial=0)) + 1, np.uint8)
        lengths[used] = sizes
        self.tables = decode_table(lengths)
        present, own, self.counts = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
        self.doc_ids = [int(x) if p else None for x, p in zip(own, present)]
        self.starts, self.payload = take("<u8", n_blocks).astype(np.int64), raw[at : at + n_bytes]
        if len(self.payload) != n_bytes:
            raise ValueError(f"the file ends early: {uri}")

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from ``first`` to ``end``, from the blocks that hold them alone."""
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        stop = self.starts[b] if b < len(self.starts) else len(self.payload) * 8
        base = int(self.starts[a]) // 32 * 32
        bits = self.payload[base // 8 : -(-int(stop) // 32) * 4].tobytes()
        n = min(b * BLOCK, self.n_ids) - a * BLOCK
        return unpack(bits, self.starts[a:b] - base, n, self.tables)[first - a * BLOCK : end - a * BLOCK]

    def documents(self, group: int = 4 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place of the first token in the file, and tokens of each document, in order."""
        upto = np.concatenate([[0], np.cumsum(self.counts)])
        i = 0
        while i < len(self.counts):
            j = max(int(np.searchsorted(upto, upto[i] + group, "right")) - 1, i + 1)
            ids = self.ids(int(upto[i]), int(upto[j]))
            for k in range(i, j):
                yield self.doc_ids[k], int(upto[k]), ids[upto[k] - upto[i] : upto[k + 1] - upto[i]]
            i = j


def counts_of(encoded: DataFrame, size: int, narrow: bool) -> np.ndarray:
    """How often each id occurs, over all rows; the result has one entry per id of the vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held, n_held = [], 0
            for blob, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist()):
                held.append(_unpack(blob.as_py(), n, narrow))
                n_held += n
                if n_held >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n_held = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = encoded.select("ids", "n_tokens").mapInArrow(trimmed(task), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = 8 << 20) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order, those without an id last.

    Rows of one id go by their number of ids and checksum. Returns a row per file:
    ``part, nr, file, n_docs, n_ids``, in the order of part and nr.
    """
    with small_batches(docs.sparkSession):
        return _write(docs, tokenizer, folder, end_id, file_ids)


def _write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, file_ids: int) -> DataFrame:
    encoded, narrow = materialise(encode(docs, tokenizer, end_id), "ids"), _narrow(tokenizer)
    size = max(_tokenizer(tokenizer)[0].get_vocab_size(), end_id + 1)
    counts = counts_of(encoded, size, narrow)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    code = docs.sparkSession.sparkContext.broadcast((lengths, codes))  # one entry per id of the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nr, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def put():
            name = store.new_name(folder, ".ids")
            sizes = np.array([len(x) for _, x in held], np.int64)
            with store.writer(name) as f:
                f.write(_file_bytes([d for d, _ in held], sizes, np.concatenate([x for _, x in held]), *code.value))
            return pa.RecordBatch.from_pylist([{"part": part, "nr": nr, "file": name, "n_docs": len(held), "n_ids": int(sizes.sum())}], _FILES)

        for batch in batches:
            for doc_id, blob, n in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("n_tokens").to_pylist()):
                held.append((doc_id, _unpack(blob.as_py(), n, narrow)))
                n_held += n
                if n_held >= file_ids:
                    yield put()
                    nr, held, n_held = nr + 1, [], 0
        if held:
            yield put()

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_tokens"), F.col("ids_crc32")]
    parts = max(1, -(-int(counts.sum()) // file_ids))
    ordered = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    return materialise(ordered.mapInArrow(trimmed(task), "part int, nr int, file string, n_docs long, n_ids long"), "id-files")


_FILES = pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: those of earlier parts (one total per part),
    of earlier files of the part, and of the file.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    )
    upto = Window.partitionBy("part").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = files.join(totals.drop("n"), "part").withColumn("base", F.col("before") + F.sum("n_ids").over(upto) - F.col("n_ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows = [(d, base + at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in Ids(name).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = materialise(placed.select("file", "base"), "placed")
    return placed.repartition(max(1, placed.count())).mapInArrow(trimmed(task), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read(write(docs, tokenizer or default_tokenizer(), scratch_path(spark, "ids")))


@query("op7_token_ids")
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "documents"))
