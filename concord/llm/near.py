"""N-gram Jaccard join: size-banded tiles with hashed bitmaps, then exact intersection of sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from concord.llm import counting, numtext
from concord.llm.components import components
from concord.llm.registry import query, small_batches, table, trimmed
from concord.session import materialise

SHINGLE = 5
PERCENT = 75
#: Bits of the bitmap by which tiles compare, and bits a shingle of the one by which pairs are held against each other.
BITS, WIDE = 512, 4
#: Tokens held before a task sorts and passes them on; sets in a part of a very frequent token; tile side.
HELD, PART, TILE = 1 << 18, 1 << 17, 1024
#: Up to so many sets of a token are compared one by one; hubs of a size band of a token with more.
FEW, HUBS = 7, 6
#: Bits of the hash by which the table of token frequency is laid out.
ORDER_BITS = 24
_FILTER_BITS = 24


# Sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each row; of all words where there are fewer."""
    rows = len(offsets) - 1
    starts, ends, row = numtext.words(data, offsets)
    own = numtext.hashes(data, starts, ends, lower=True)
    values, at = numtext.windows(own, row, SHINGLE)
    n = np.bincount(row, minlength=rows)
    upto = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=rows))])
    first = np.cumsum(n) - n
    out = []
    for i in range(rows):
        if n[i] >= SHINGLE:
            out.append(np.unique(values[upto[i] : upto[i + 1]]))
        elif n[i]:
            whole, _ = numtext.windows(own[first[i] : first[i] + n[i]], np.zeros(n[i], np.int64), int(n[i]))
            out.append(numtext.mix(whole + np.uint64(n[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(values: np.ndarray, seed: int = 0) -> int:
    """A 64-bit hash of a set; equal sets have equal ones. 0 for the empty set."""
    if not len(values):
        return 0
    total = numtext.mix(values + np.uint64(len(values) + seed)).sum(dtype=np.uint64)
    return int(numtext.mix(np.array([total], np.uint64)).view(np.int64)[0])


def second_of(values: np.ndarray) -> int:
    return class_of(values, 0x9E3779B9)


def name_of(values: np.ndarray, shared: frozenset[int]) -> int:
    """The name of a set: its hash, or where different sets have that hash (``shared``), both hashes mixed.

    So sets are told apart by 128 bits, and names need only 64.
    """
    cls = class_of(values)
    return mixed_name(cls, second_of(values)) if cls in shared and len(values) else cls


def mixed_name(cls: int, second: int) -> int:
    both = numtext.mix(np.array([cls, second], np.int64).view(np.uint64) + np.array([1, 2], np.uint64))
    return int(numtext.mix(both[:1] + numtext.mix(both[1:])).view(np.int64)[0])


def bitmap(values: np.ndarray, size: int = BITS) -> bytes:
    """A bit for each remainder of a hash; ``size`` is a power of two, so halves can be laid over each other."""
    bits = np.zeros(size, bool)
    bits[(values & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def wide_bitmap(values: np.ndarray) -> bytes:
    return bitmap(values, 1 << max(9, (WIDE * len(values) - 1).bit_length()))


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as words, its parts laid over each other down to ``size`` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(0), "text")


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``: ``row`` names the content of a row, so ids may be null or repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), F.col("text").cast("string").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for a, b, data, offsets in numtext.slices(batch.column("text")):
            yield batch.slice(a, b - a), b - a, shingle_sets(data, offsets)


def summaries(docs: DataFrame) -> DataFrame:
    """``doc_id, row, cls, second, n, bits, wide`` per row: two hashes, the size and bitmaps of its set."""

    def task(batches):
        for batch, _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([class_of(x) for x in sets], pa.int64()),
                 pa.array([second_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.binary()),
                 pa.array([wide_bitmap(x) for x in sets], pa.binary())],
                names=["doc_id", "row", "cls", "second", "n", "bits", "wide"],
            )

    return _texts(docs).mapInArrow(trimmed(task), "doc_id long, row long, cls long, second long, n long, bits binary, wide binary")


# Tokens that two or more sets share


def rarity(docs: DataFrame, total: int, shared: frozenset[int], least: int = 8) -> np.ndarray:
    """How frequent tokens are, in quarter powers of two, by the first ``ORDER_BITS`` bits of their hash; 0 below ``least`` sets.

    All tokens of all sets are counted; ``total`` is about their number. The table only sets the order in which tokens are
    looked at, so keys that fall together cost time and nothing else. Its size is fixed.
    """
    ranges = counting.ranges_for(total, bits=ORDER_BITS)

    def spread(batches):
        runs, seen = counting.Runs(ranges, 2 * HELD), set()
        for _, _, sets in _sets(batches):
            new = []
            for values in sets:
                name = name_of(values, shared)
                if len(values) and name not in seen:
                    seen.add(name)
                    new.append(values)
            if new:
                yield from runs.add(np.concatenate(new))
            if len(seen) > HELD:
                seen = set()
        yield from runs.rest()

    quarters = lambda n: np.where(n >= least, np.minimum(4 * np.log2(n), 255), 0).astype(np.uint8)
    return counting.table_of(_texts(docs), spread, ranges, 1 << ORDER_BITS, quarters)


def prefix_length(n: int) -> int:
    """So many of its first tokens, in any one order of all tokens, hold one of every set that links with it."""
    return n - -(-n * PERCENT // 100) + 1


def shared_tokens(docs: DataFrame, total: int, shared: frozenset[int] = frozenset()) -> DataFrame:
    """What the tokens that two or more prefixes share say about pairs of sets.

    Linked sets share a token of their prefixes: at least 75 % of the larger set is common to both. The
    order puts frequent tokens last, so a passage of many documents is in a prefix only of documents that
    are little else. Of a token with few sets every two make a pair. Of others, the sets of a size band whose
    names are least under several mixings are its hubs; every set makes a pair with those of its band, and hubs of
    neighbouring bands do. As names rule everywhere, near copies choose the same few hubs at all their tokens. Pairs come as rows ``a, b`` with a null ``token``.
    Tokens of more sets also give a row ``token, a, n, place, hub`` a set: its size, the tokens of it that come before, and
    whether it is a hub. Pairs that sizes or places rule out are left out. Tokens travel in packed runs by range of their
    value; ``total`` of them make so many ranges that each fits a task. Very frequent tokens are dealt out further by the
    names of sets; they have hubs in each part. A set that repeats within a task is passed on once.
    """
    spark = docs.sparkSession
    ranges = 1 << max(3, int(np.ceil(np.log2(max(1, total / HELD)))))
    shift = np.uint64(64 - ranges.bit_length() + 1)
    known = spark.sparkContext.broadcast(rarity(docs, total * 4, shared))  # 16 MB at every size

    def parts_of(tokens: np.ndarray) -> np.ndarray:
        """Parts over which a token's sets are dealt."""
        often = 2.0 ** (known.value[_place_of(tokens)] / 4)
        return np.maximum(often / PART, 1).astype(np.int64)

    def spread(batches):
        held, size, seen = [], 0, set()

        def packed():
            t, c, n, at = (np.concatenate(x) for x in zip(*held))
            parts = parts_of(t)
            part = (c.view(np.uint64) % parts.astype(np.uint64)).astype(np.uint64)
            home = np.where(part > 0, numtext.mix(t + part), t) >> shift
            order = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[order], np.arange(ranges + 1, dtype=np.uint64))
            keep = [i for i in range(ranges) if cut[i] < cut[i + 1]]
            packs = [[x[order[cut[i] : cut[i + 1]]].tobytes() for i in keep] for x in (t, c, n, at)]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), *[pa.array(x, pa.binary()) for x in packs]], names=["range", *_PACKED])

        for _, _, sets in _sets(batches):
            for values in sets:
                cls = name_of(values, shared)
                if not len(values) or cls in seen:
                    continue
                seen.add(cls)
                order = np.argsort(known.value[_place_of(values)], kind="stable")
                prefix = values[order[: prefix_length(len(values))]]
                n = len(prefix)
                held.append((prefix, np.full(n, cls, np.int64), np.full(n, len(values), np.uint32), np.arange(n, dtype=np.uint32)))
                size += n
            if size >= HELD:
                yield packed()
                held, size = [], 0
                if len(seen) > HELD:
                    seen = set()
        if size:
            yield packed()

    def gather(batches):
        held, now = [], None
        for batch in batches:
            for r, *parts in zip(batch.column("range").to_pylist(), *(batch.column(c) for c in _PACKED)):
                if r != now and held:
                    yield from _pairs_and_entries(held, parts_of)
                    held = []
                now = r
                held.append([x.as_py() for x in parts])
        if held:
            yield from _pairs_and_entries(held, parts_of)

    runs = _texts(docs).mapInArrow(trimmed(spread), "range int, " + ", ".join(f"{c} binary" for c in _PACKED))
    runs = runs.repartitionById(ranges, "range").sortWithinPartitions("range")
    return runs.mapInArrow(trimmed(gather), "token long, a long, b long, n long, place long, hub boolean")


def _place_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


_PACKED = ("tokens", "names", "sizes", "places")


def bands(n: np.ndarray) -> np.ndarray:
    """Size bands, each 4/3 of the one before: links stay in a band or reach the next."""
    return np.floor(np.log(n) / np.log(100 / PERCENT)).astype(np.int64)


def _pairs_and_entries(held: list, parts_of) -> Iterator[pa.RecordBatch]:
    """The rows of ``shared_tokens`` for one range of tokens, from what all tasks passed on."""
    t, c, n, at = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), (np.uint64, np.int64, np.uint32, np.uint32)))
    band = bands(n)
    order = np.lexsort((c, band, t))
    t, c, band = t[order], c[order], band[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c, band, n, at = t[new], c[new], band[new], n[order][new].astype(np.int64), at[order][new].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    m = np.diff(np.append(first, len(t)))
    start, size = np.repeat(first, m), np.repeat(m, m)
    found = []

    def add(own: np.ndarray, other: np.ndarray) -> None:
        ok = (own != other) & _can_link(n[own], n[other]) & _enough_left(n[own], n[other], at[own], at[other])
        x, y = c[own[ok]], c[other[ok]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))

    few = np.flatnonzero((size > 1) & (size <= FEW))
    for k in range(FEW - 1):
        own = few[size[few] > k]
        add(own, start[own] + k)
    many = np.flatnonzero(size > FEW)
    # runs of one token and band; hubs are the sets whose names are least, after one of several mixings
    new_run = np.concatenate([[True], (t[1:] != t[:-1]) | (band[1:] != band[:-1])]) if len(t) else np.zeros(0, bool)
    run_start = np.flatnonzero(new_run)
    run = np.cumsum(new_run) - 1
    if len(many):
        for k in range(HUBS):
            keys = numtext.mix(c.view(np.uint64) + np.uint64(k)) if k else c.view(np.uint64)
            least = np.flatnonzero(keys == np.minimum.reduceat(keys, run_start)[run])
            add(many, least[run[many]])
        # the hubs of neighbouring bands stand for what lies on both sides of their border
        first_run = np.unique(run[many])
        last = first_run[first_run + 1 < len(run_start)]
        here, there = run_start[last], run_start[last + 1]
        beside = (t[here] == t[there]) & (band[here] + 1 == band[there])
        add(here[beside], there[beside])
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    none = lambda k: pa.nulls(k, pa.int64())
    for i in range(0, len(pairs), 1 << 18):
        x, y = pairs[i : i + (1 << 18)].T
        yield pa.RecordBatch.from_arrays([none(len(x)), pa.array(x), pa.array(y), none(len(x)), none(len(x)), pa.nulls(len(x), pa.bool_())], names=_ROWS)
    split = parts_of(t) > 1
    lasting = np.flatnonzero((size > FEW) | split)
    hub = split & new_run
    for i in range(0, len(lasting), 1 << 18):
        j = lasting[i : i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(t[j].view(np.int64)), pa.array(c[j]), none(len(j)), pa.array(n[j]), pa.array(at[j]), pa.array(hub[j])], names=_ROWS)


_ROWS = ["token", "a", "b", "n", "place", "hub"]


def hubs_of_parts(entries: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the hubs of a dealt-out token's parts with the least of them in their band."""
    own = entries.filter("hub").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")).select("token", "band", F.col("cls").alias("a"))
    least = own.groupBy("token", "band").agg(F.min("a").alias("b"))
    return own.join(least, ["token", "band"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# Candidates


def _enough_left(n1, n2, place1, place2):
    """Whether enough tokens follow, and with it, for the two sets to link if this is the first they share."""
    return np.minimum(n1 - place1, n2 - place2) * (100 + PERCENT) >= (n1 + n2) * PERCENT


def _can_link(n1, n2):
    return (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)


def _bound(n1: np.ndarray, n2: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether 75 % can be reached: each bit that one bitmap alone has is a shingle that the other set lacks."""
    most = np.minimum(n1 - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n2 - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return most * 100 >= (n1 + n2 - most) * PERCENT


def _words_of(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that sizes and the wide bitmaps allow."""

    def task(batches):
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy().astype(np.int64) for c in ("n1", "n2"))
            keep = np.zeros(len(n1), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = x.as_py(), y.as_py()
                size = min(len(x), len(y))
                keep[i] = _bound(n1[i : i + 1], n2[i : i + 1], folded(x, size)[None], folded(y, size)[None])[0]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("wide").alias("x"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("wide").alias("y"))
    both = pairs.join(one, "a").join(two, "b").filter(_can_link(F.col("n1"), F.col("n2")))
    return both.select("a", "b", "n1", "n2", "x", "y").mapInArrow(trimmed(task), "a long, b long")


def tiles(entries: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share a token and pass sizes and bitmaps.

    Only tokens of two or more components are looked at. The sets of a token are laid out by size bands, each
    4/3 of the one before, so that links stay within a band or reach the next; a band with more than
    ``TILE`` sets is cut into blocks by hash, and every two blocks make a tile. So no task gets a token whole. A pair
    is taken from a token only if enough tokens follow it in both sets, as they must after the first they share.
    """
    rooted = entries.select("token", "cls", "n", "place").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = materialise(rooted, "rooted")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("token")
    own = materialise(rooted.join(mixed, "token"), "mixed")
    own = own.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int"))
    blocks = own.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k"), (F.count("*") > 1).alias("some"))
    blocks = materialise(blocks, "bands")
    after = blocks.select("token", (F.col("band") - 1).alias("band"), F.col("k").alias("k_next"))
    before = blocks.select("token", (F.col("band") + 1).alias("band"), F.col("k").alias("k_last"))
    own = own.join(blocks, ["token", "band"]).join(after, ["token", "band"], "left").join(before, ["token", "band"], "left")
    own = own.filter("some or k_next is not null or k_last is not null")  # others meet nobody
    own = own.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    upto = lambda k: F.when(F.coalesce(k, F.lit(0)) > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(upto(F.when(F.col("some"), F.col("k"))), lambda j: F.struct(F.col("band").alias("low"), F.least("i", j).alias("p"), (F.greatest("i", j) * 2).alias("q"), F.lit(0).alias("side")))
    next_ = F.transform(upto(F.col("k_next")), lambda j: F.struct(F.col("band").alias("low"), F.col("i").alias("p"), (j * 2 + 1).alias("q"), F.lit(1).alias("side")))
    last = F.transform(upto(F.col("k_last")), lambda j: F.struct((F.col("band") - 1).alias("low"), j.alias("p"), (F.col("i") * 2 + 1).alias("q"), F.lit(2).alias("side")))
    laid = own.select("token", "cls", "root", "n", "place", F.explode(F.concat(within, next_, last)).alias("t")).select("token", "cls", "root", "n", "place", "t.*")
    laid = laid.join(classes.select("cls", "bits"), "cls")
    laid = laid.withColumn("tile", F.xxhash64("token", "low", "p", "q")).select("tile", "cls", "root", "n", "place", "side", "bits")

    def task(batches):
        left = None
        for batch in batches:
            part = [batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "cls", "root", "n", "place", "side")] + [_words_of(batch.column("bits"))]
            part = part if left is None else [np.concatenate(x) for x in zip(left, part)]
            cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            left = [x[cut:] for x in part]
            yield from compared([x[:cut] for x in part])
        if left is not None:
            yield from compared(left)

    def compared(part):
        tile, cls, root, n, place, side, bits = part
        size = len(tile)
        end = np.searchsorted(tile, tile, "right") if size else tile
        live, k = np.arange(size), 1
        while len(live):
            live = live[live + k < end[live]]
            for a in range(0, len(live), 1 << 16):
                i = live[a : a + (1 << 16)]
                j = i + k
                ok = (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j])) & _can_link(n[i], n[j])
                ok &= _enough_left(n[i], n[j], place[i], place[j])
                i, j = i[ok], j[ok]
                ok = _bound(n[i], n[j], bits[i], bits[j])
                i, j = cls[i[ok]], cls[j[ok]]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])
            k += 1

    return laid.repartition("tile").sortWithinPartitions("tile").mapInArrow(trimmed(task), "a long, b long").distinct()


# Exact verification


def _arrays(docs: DataFrame, wanted: DataFrame, shared: frozenset[int]) -> DataFrame:
    """``cls, shingles`` of the wanted sets, from the one row that stands for each.

    Rows are picked by a bit filter of fixed size, made from the wanted rows; rows that pass without
    being wanted cost time and fall away in the joins that follow.
    """
    spark = docs.sparkSession
    bit = F.pmod("row", F.lit(1 << _FILTER_BITS))
    words = wanted.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(row, {1 << _FILTER_BITS}), 64) as int))").alias("v"))
    words = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy()
    known = spark.sparkContext.broadcast(bits.view(np.uint64))

    def task(batches):
        for batch in batches:
            at = batch.column("row").to_numpy().view(np.uint64) & np.uint64((1 << _FILTER_BITS) - 1)
            hit = (known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            for _, _, sets in _sets([some]):
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x, shared) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "shingles"])

    every = _texts(docs).select("row", "text").mapInArrow(trimmed(task), "cls long, shingles binary")
    return every.dropDuplicates(["cls"])


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs whose sets link, with the sizes of intersection and union."""

    def task(batches):
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[place] == x).sum()))
                total.append(len(x) + len(y) - shared[-1])
            shared, total = np.array(shared, np.int64), np.array(total, np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared), pa.array(total)], names=["a", "b", "shared", "total"])
            yield out.filter(pa.array(shared * 100 >= total * PERCENT))

    one = arrays.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    two = arrays.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(trimmed(task), "a long, b long, shared long, total long")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets, verified links between sets, and components of sets.

    Exact copies meet in one set, so links are between different texts; ``links`` hold enough of them for the
    components, not every one within a component. First each set is held against the hubs of every token it shares; components of these links already hold nearly all near copies. Then tiles
    look at every pair that shares a token across components, so no component is missed while pairs
    within one are not spelled out. Returns ``rows`` (doc_id, row, cls, n, bits, wide), ``links`` (a, b, shared, total)
    and ``roots`` (node, root).
    """
    with small_batches(docs.sparkSession):
        return _join(docs)


def _named(rows: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """The rows with ``cls`` as the name of the set, and the hashes that different sets have."""
    kinds = rows.filter("n > 0").groupBy("cls").agg(F.min("second").alias("low"), F.max("second").alias("high"))
    shared = frozenset(r.cls for r in kinds.filter("low <> high").select("cls").collect())  # one in 2**64 pairs
    if not shared:
        return rows.drop("second"), shared

    def task(batches):
        for batch in batches:
            cls, second, n = (batch.column(c).to_pylist() for c in ("cls", "second", "n"))
            names = [mixed_name(a, b) if k and a in shared else a for a, b, k in zip(cls, second, n)]
            yield batch.set_column(batch.schema.get_field_index("cls"), "cls", pa.array(names, pa.int64()))

    return materialise(rows.mapInArrow(trimmed(task), rows.schema), "named-sets").drop("second"), shared


def _join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, shared = _named(materialise(summaries(docs), "sets"))
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide"))
    classes = materialise(classes, "classes")
    total = classes.agg(F.sum(F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1")).alias("t")).first().t or 0
    tokens = materialise(shared_tokens(docs, int(total), shared), "tokens")
    named = lambda p: p.select(F.col("a").alias("cls")).unionAll(p.select(F.col("b").alias("cls")))
    entries = tokens.filter("token is not null").withColumnRenamed("a", "cls")
    pairs = tokens.filter("token is null").select("a", "b").unionAll(hubs_of_parts(entries)).distinct()
    hubs = materialise(_likely(pairs, classes), "hubs")
    arrays = materialise(_arrays(docs, named(hubs).distinct().join(classes, "cls").select("row"), shared), "arrays")
    links = materialise(_verified(hubs, arrays), "links")
    roots = components(links)
    more = _likely(materialise(tiles(entries, classes, roots), "pairs"), classes)
    more = materialise(more.join(hubs, ["a", "b"], "left_anti"), "more")
    lacking = named(more).distinct().join(arrays.select("cls"), "cls", "left_anti").join(classes, "cls").select("row")
    if not more.isEmpty():
        arrays = arrays.unionAll(materialise(_arrays(docs, lacking, shared), "arrays").join(arrays.select("cls"), "cls", "left_anti"))
        found = materialise(_verified(more, arrays), "links")
        links = links.unionAll(found)
        if not found.isEmpty():
            roots = components(links)
    return rows, links, roots


def labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, row, root, n_shingles, component_id`` per row.

    Texts that are null or have no word link with nothing, nor do they with each other. Rows without an id take
    part in links; a component in which no row has an id has a null component_id. Rows that repeat are
    copies like any others.
    """
    rows, _, roots = join(docs)
    own = rows.drop("bits", "wide").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = materialise(own, "rooted")
    least = materialise(own.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = own.join(least, "root", "left")
    return out.select("doc_id", "row", "root", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _digest(docs: DataFrame):
    """SHA-256 of all columns of a row, each with its length, or marked as null."""
    simple = {f.name: isinstance(f.dataType, AtomicType) for f in docs.schema.fields}
    text = lambda c: F.col(f"`{c}`").cast("string") if simple[c] else F.to_json(F.struct(f"`{c}`"), {"ignoreNullFields": "false"})
    part = lambda c: F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n"))
    return F.sha2(F.concat(*[part(c) for c in docs.columns]).cast("binary"), 256)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are the first of their component.

    First is the smallest id, rows without an id last, then the content of all columns, by its SHA-256. Rows that
    repeat it whole are one. Documents without a word link with nothing and all stay, but rows that repeat one
    of them whole are one as well. Dropped rows are found by joins on digests, so the texts that stay are not grouped.
    """
    inner = "row of this stage"
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _digest(docs).alias(inner))
    names = materialise(own.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), F.col(f"`{inner}`").alias("whole")), "row-names")
    roots = materialise(labelled(docs).filter("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "root").distinct(), "row-roots")
    named = names.join(roots, (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).drop("id", "of")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("whole").alias("whole"))
    first = materialise(named.groupBy("root").agg(F.min(key).alias("first")), "first")
    gone = materialise(named.join(first, "root").filter(F.col("whole") != F.col("first.whole")).select(F.col("whole").alias("gone")).distinct(), "gone")
    own = own.join(gone, own[inner] == gone["gone"], "left_anti")
    again = materialise(names.groupBy(F.col("whole").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"), "again")
    same = own[inner] == again["again"]
    once, more = own.join(again, same, "left_anti"), own.join(again, same, "left_semi").dropDuplicates([inner])
    return once.unionAll(more).drop(inner)


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
