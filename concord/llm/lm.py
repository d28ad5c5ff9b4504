"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped files.

Level 1 is the vocabulary, sorted by hash and cut into shards by ranges of it. A node of level k is an n-gram of
k words; nodes are numbered in the order of their parents, so the children of a node are a range, given by
monotone pointers (Elias-Fano), and a word is found among them by successor search within that range. The
children of a shard's nodes lie in the same shard, so each is built by one task from counts that were
added up before the shuffle, and no task or driver holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import numtext, store, succinct
from concord.llm.registry import fold, query, table
from concord.session import materialise, scratch_path

#: The end of a text, as a token.
END = np.uint64(0x5EED_0F_7E27_E2D)
DISCOUNT = 0.75
#: Steps of a quantised log10: 16 bits reach from 1 to 1e-16.
STEPS = 4096
#: n-grams held in a task before they are passed on; tokens of a shard.
HELD, SHARD = 1 << 20, 1 << 22


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(float) / STEPS)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row in small letters, then the end; and the row of each."""
    starts, ends, row = numtext.words(data, offsets)
    rows = len(offsets) - 1
    out, rows_of = np.full(len(starts) + rows, END), np.empty(len(starts) + rows, np.int64)
    place = np.arange(len(starts)) + row
    out[place] = numtext.hashes(data, starts, ends, lower=True)
    rows_of[place] = row
    last = np.cumsum(np.bincount(row, minlength=rows) + 1) - 1
    rows_of[last] = np.arange(rows)
    return out, rows_of


@dataclass
class Trie:
    """Where the levels are. ``base[k][s]`` is the number of nodes of level k + 1 in shards before s."""

    shards: int
    total: int = 0
    kinds: int = 0
    files: list[list[str]] = field(default_factory=list)
    base: list[np.ndarray] = field(default_factory=list)

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int64) if self.shards > 1 else np.zeros(len(hashes), np.int64)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in the vocabulary, or -1, and training count of each hash."""
        kinds, which = np.unique(hashes, return_inverse=True)
        ids, n = np.full(len(kinds), -1), np.zeros(len(kinds), np.int64)
        for s, a, b in _cuts(self.shard_of(kinds), self.shards):
            shard = _bundle(self.files[0][s])
            if len(shard["hash"]):
                at = np.minimum(np.searchsorted(shard["hash"], kinds[a:b]), len(shard["hash"]) - 1)
                hit = shard["hash"][at] == kinds[a:b]
                ids[a:b] = np.where(hit, at + self.base[0][s], -1)
                n[a:b] = np.where(hit, shard["n"][at], 0)
        return ids[which], n[which]

    def children(self, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each parent (-1: none) and word: the node at ``level``, its own probability, the parent's weight for shorter contexts."""
        bits = max(1, self.kinds.bit_length())
        if int(self.base[level - 2][-1]).bit_length() + bits < 63 and len(parents):  # ask once for what occurs again
            kinds, which = np.unique(np.where(parents < 0, -1, (parents << bits) | (words + 1)), return_inverse=True)
            parents, words = kinds >> bits, (kinds & ((1 << bits) - 1)) - 1
            return tuple(x[which] for x in self._children(level, parents, words))
        return self._children(level, parents, words)

    def _children(self, level: int, parents: np.ndarray, words: np.ndarray):
        node, own, weight = np.full(len(parents), -1), np.zeros(len(parents)), np.ones(len(parents))
        live = np.flatnonzero(parents >= 0)
        if len(live) and (np.diff(parents[live]) < 0).any():
            live = live[np.argsort(parents[live], kind="stable")]
        base = self.base[level - 2]
        sorted_ = parents[live]
        for s, a, b in _cuts(np.searchsorted(base, sorted_, "right") - 1, len(base) - 1):
            shard, at = _bundle(self.files[level - 1][s]), live[a:b]
            local = sorted_[a:b] - base[s]
            new = np.concatenate([[True], local[1:] != local[:-1]])
            kinds, which = local[new], np.cumsum(new) - 1
            pointers = _sequence(shard)
            ends = succinct.elias_fano_at(pointers, np.concatenate([kinds, kinds + 1]))
            start, end = ends[: len(kinds)][which], ends[len(kinds) :][which]
            weight[at] = restored(shard["weight"][kinds])[which]
            bits = int(shard["width"][0])
            place = _successor(shard["word"], bits, start, end, words[at])
            some = np.flatnonzero(place < end)
            some = some[succinct.unpack(shard["word"], bits, place[some]) == words[at[some]]]
            node[at[some]] = place[some] + self.base[level - 1][s]
            own[at[some]] = restored(shard["p"][place[some]])
        return node, own, weight


def _successor(packed: np.ndarray, bits: int, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The first place from ``start`` to ``end`` whose word is not below; all at once, by halving."""
    low, high = start.copy(), end.copy()
    live = np.flatnonzero((low < high) & (words >= 0))
    low[words < 0] = end[words < 0]
    while len(live):
        mid = (low[live] + high[live]) >> 1
        below = succinct.unpack(packed, bits, mid) < words[live]
        low[live[below]] = mid[below] + 1
        high[live[~below]] = mid[~below]
        live = live[low[live] < high[live]]
    return low


def _cuts(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted array of shard numbers."""
    ends = np.searchsorted(shard, np.arange(shards + 1))
    return ((s, int(ends[s]), int(ends[s + 1])) for s in range(shards) if ends[s] < ends[s + 1])


@lru_cache(maxsize=4096)
def _bundle(uri: str) -> dict[str, np.ndarray]:
    return succinct.read_bundle(uri)


def _sequence(shard: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: shard[f"pointer_{k}"] for k in ("low", "high", "ones", "shape")}


# Building


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", 7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for a, b, data, offsets in numtext.slices(batch.column("text"), 2 * numtext.SLICE):
            yield batch.slice(a, b - a), *tokens(data, offsets)


def _added(first: np.ndarray, second: np.ndarray | None, n: np.ndarray):
    """Counts of equal keys added up, in the order of keys."""
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    first, n = first[order], n[order]
    second = second if second is None else second[order]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    at = np.flatnonzero(new)
    return first[at], second if second is None else second[at], np.add.reduceat(n, at) if len(at) else n


def _packed(first, second, n, shard, shards) -> pa.RecordBatch:
    """One row per shard: the sorted keys and counts of a task, as bytes."""
    rows = [
        {"shard": s, "first": first[a:b].tobytes(), "second": b"" if second is None else second[a:b].astype(np.uint32).tobytes(), "n": n[a:b].astype(np.uint32).tobytes()}
        for s, a, b in _cuts(shard, shards)
    ]
    return pa.RecordBatch.from_pylist(rows, _PACKED)


_PACKED = pa.schema([("shard", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("n", pa.binary())])
_PACKED_SQL = "shard int, first binary, second binary, n binary"


def _by_shard(packed: DataFrame, shards: int, build, schema: pa.Schema, sql: str) -> DataFrame:
    """``build(shard, first, second, n)`` once for every shard, on the counts of all tasks."""

    def task(batches):
        held, now = [], None

        def done():
            first = np.concatenate([np.frombuffer(x, np.uint64) for x, _, _ in held])
            second = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in held])
            n = np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in held]).astype(np.int64)
            return pa.RecordBatch.from_pylist([build(now, *_added(first, second if len(second) else None, n))], schema)

        for batch in batches:
            for s, first, second, n in zip(*(batch.column(c) for c in ("shard", "first", "second", "n"))):
                if s.as_py() != now and held:
                    yield done()
                    held = []
                now = s.as_py()
                held.append((first.as_py(), second.as_py(), n.as_py()))
        if held:
            yield done()

    return packed.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(task, sql)


def _vocabulary(docs: DataFrame, folder: str, shards: int) -> Trie:
    trie = Trie(shards)

    def count(batches):
        keys, n, size = [], [], 0

        def out():
            first, _, total = _added(np.concatenate(keys), None, np.concatenate(n))
            return _packed(first, None, total, trie.shard_of(first), shards)

        for batch, own, row in _slices(batches):
            train = ~np.array(batch.column("held_out").to_pylist(), bool)
            kinds, times = np.unique(own[train[row]], return_counts=True)
            keys.append(kinds)
            n.append(times)
            size += len(kinds)
            if size >= HELD:
                yield out()
                keys, n, size = [], [], 0
        if size:
            yield out()

    def build(shard, first, _, n):
        name = store.new_name(folder, ".words")
        succinct.write_bundle(name, {"hash": first, "n": n if n.max(initial=0) >> 32 else n.astype(np.uint32)})
        return {"shard": shard, "file": name, "nodes": len(first), "total": int(n.sum())}

    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("nodes", pa.int64()), ("total", pa.int64())])
    packed = _texts(docs).mapInArrow(count, _PACKED_SQL)
    rows = materialise(_by_shard(packed, shards, build, schema, "shard int, file string, nodes long, total long"), "words").collect()  # a row per shard
    made = {r.shard: r for r in rows}
    empty = ""
    if len(made) < shards:
        empty = store.new_name(folder, ".words")
        succinct.write_bundle(empty, {"hash": np.zeros(0, np.uint64), "n": np.zeros(0, np.uint32)})
    trie.files.append([made[s].file if s in made else empty for s in range(shards)])
    trie.base.append(np.concatenate([[0], np.cumsum([made[s].nodes if s in made else 0 for s in range(shards)])]).astype(np.int64))
    trie.kinds, trie.total = int(trie.base[0][-1]), sum(r.total for r in rows)
    return trie


def _level(nodes: np.ndarray, parents: int, words: np.ndarray, n: np.ndarray, vocabulary: int, least: int) -> dict[str, np.ndarray]:
    """Arrays of a shard's level: nodes of at least ``least`` occurrences, in the order of (parent, word).

    Absolute discounting: a node keeps (n - D) of its parent's occurrences; what kept nodes do not hold
    goes to the shorter context, so that the probabilities of a context add up to one.
    """
    total = np.bincount(nodes, n, parents)
    keep = n >= least
    nodes, words, n = nodes[keep], words[keep], n[keep]
    p = (n - DISCOUNT) / total[nodes]
    held = np.bincount(nodes, p, parents)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(nodes, minlength=parents))])
    width = max(1, vocabulary.bit_length())
    out = {"word": succinct.pack(words, width), "width": np.array([width]), "p": quantised(p) if len(p) else np.zeros(0, np.uint16), "weight": quantised(np.maximum(1 - held, 1e-16))}
    return out | {f"pointer_{k}": v for k, v in succinct.elias_fano(pointers, len(n) + 1).items()}


def _grown(docs: DataFrame, trie: Trie, folder: str, least: int) -> None:
    """Add the next level: children of the nodes of the last one, counted over all training texts."""
    level, shards = len(trie.files) + 1, trie.shards
    known = docs.sparkSession.sparkContext.broadcast(trie)
    base = trie.base[-1]

    def count(batches):
        held, size = [], 0

        def out():
            first, second, n = _added(*(np.concatenate(x) for x in zip(*held)))
            return _packed(first, second, n, np.searchsorted(base, first.astype(np.int64), "right") - 1, shards)

        for batch, own, row in _slices(batches):
            train = ~np.array(batch.column("held_out").to_pylist(), bool)
            own, row = own[train[row]], row[train[row]]
            ids, _ = known.value.words(own)
            node = ids
            for k in range(2, level):
                node = _followed(known.value, k, node, ids, row)[0]
            parent, word = _before(node, row)[1:], ids[1:]
            some = parent >= 0
            held.append((parent[some].astype(np.uint64), word[some].astype(np.uint32), np.ones(int(some.sum()), np.int64)))
            size += int(some.sum())
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def write(shard, parents, words, n):
        name = store.new_name(folder, f".level{level}")
        arrays = _level(parents.astype(np.int64) - base[shard], int(base[shard + 1] - base[shard]), words.astype(np.int64), n, trie.kinds, least)
        succinct.write_bundle(name, arrays)
        return len(arrays["p"]), name

    def build(shard, first, second, n):
        second = np.zeros(0, np.uint32) if second is None else second
        nodes, name = write(shard, first, second, n)
        return {"shard": shard, "file": name, "nodes": nodes}

    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("nodes", pa.int64())])
    packed = _texts(docs).filter("not held_out").mapInArrow(count, _PACKED_SQL)
    made = {r.shard: r for r in materialise(_by_shard(packed, shards, build, schema, "shard int, file string, nodes long"), "level").collect()}
    none = np.zeros(0, np.int64)
    files, nodes = [], []
    for s in range(shards):
        n, name = (made[s].nodes, made[s].file) if s in made else write(s, none, none, none)
        files.append(name)
        nodes.append(n)
    trie.files.append(files)
    trie.base.append(np.concatenate([[0], np.cumsum(nodes)]).astype(np.int64))


def _before(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The value one place earlier in the same row, or -1."""
    out = np.full(len(values), -1)
    if len(values):
        out[1:] = np.where(row[1:] == row[:-1], values[:-1], -1)
    return out


def _followed(trie: Trie, level: int, node: np.ndarray, ids: np.ndarray, row: np.ndarray):
    return trie.children(level, _before(node, row), ids)


def trained(docs: DataFrame, order: int = 3, least: int = 2, folder: str | None = None) -> Trie:
    """The trie of all training texts (crc32 of the id, modulo 7, is not 2; a text without id is held out).

    n-grams of two words and more are kept from ``least`` occurrences on; the mass of others goes to shorter
    contexts. The number of shards follows the size of the texts.
    """
    folder = folder or scratch_path(docs.sparkSession, "trie")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first().n or 0
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, size / 5 / SHARD)))))
    trie = _vocabulary(docs, folder, shards)
    for _ in range(1, order):
        _grown(docs, trie, folder, least)
    return trie


# Scoring


def probabilities(trie: Trie, own: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count and model probability of each token after those before it."""
    ids, n = trie.words(own)
    p = (n + 1) / (trie.total + trie.kinds + 1)
    node = ids
    for level in range(2, len(trie.files) + 1):
        node, kept, weight = _followed(trie, level, node, ids, row)
        p = kept + weight * p
    return n, p


def scored(docs: DataFrame, trie: Trie | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    A null or empty text is its end alone. With nothing learned every token has count 0 and a probability of
    one. Ids may be null or repeat.
    """
    trie = trie or trained(docs)
    known = docs.sparkSession.sparkContext.broadcast(trie)

    def task(batches):
        for batch, own, row in _slices(batches):
            model, rows = known.value, batch.num_rows
            n, p = probabilities(model, own, row)
            base = np.log10((n + 1) / (model.total + (model.kinds + 1)))
            sums = lambda w: np.bincount(row, w, rows)
            count = lambda at: np.bincount(at, minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(count(row)), pa.array(count(row[n > 0])),
                 pa.array(np.full(rows, model.total)), pa.array(sums(base)), pa.array(sums(np.log10(p)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _texts(docs).mapInArrow(task, kinds)


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, least=1))
