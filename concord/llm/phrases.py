"""Phrase collocation mining over sorted count streams.

Counts of phrases of one to five words form a stream that is sorted twice: by the words from the first on (prefix
order) and from the last on (suffix order). In prefix order a phrase follows the phrases it begins with, so one
pass with a stack meets the count of each left part and of each one-word extension to the right in lockstep; in
suffix order the same pass meets right parts and extensions to the left. Nothing is looked up by hash.

A part of a phrase occurs at least as often as the phrase. So phrases are first counted by hash, those of one word,
then of two and so on, where their parts are frequent; a bitmap of fixed size says which can still be. It may let
through too much, which costs time. What it lets through is counted by 64-bit hash, and what is frequent spelled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm import counting, numtext
from concord.llm.registry import query, small_batches, table, trimmed
from concord.session import materialise

LEAST, LONGEST, TOP = 100, 5, 2000
#: What ends a piece, and what parts words besides.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
#: Bits of the bitmap of frequent windows; windows held in a task; phrases held in a task.
FILTER_BITS, HELD, PHRASES = 27, 1 << 20, 1 << 19

_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_INSIDE = np.ones(256, bool)
_INSIDE[list(ENDS + BLANKS)] = False


# Windows


class Words:
    """The words of some rows: where they are, their piece, and hashes that differ by language."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.rows = numtext.runs(_INSIDE[data], offsets)
        passed = np.concatenate([[0], np.cumsum(_END[data])])
        self.pieces = passed[self.starts] + self.rows
        langs, at = numtext.column(batch.column("lang"))
        self.salt = numtext.hashes(langs, at[:-1], at[1:])
        self.hashes = numtext.mix(numtext.hashes(data, self.starts, self.ends, lower=True) + self.salt[self.rows])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of so many words in a piece."""
        if size == 1:
            return self.hashes, np.arange(len(self.hashes))
        return numtext.windows(self.hashes, self.pieces, size)

    def text(self, first: int, size: int) -> list[str]:
        return [self.data[self.starts[i] : self.ends[i]].tobytes().lower().decode() for i in range(first, first + size)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for a, b, data, offsets in numtext.slices(batch.column("text")):
            own = batch.slice(a, b - a)
            yield own, Words(own, data, offsets)


def _may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(62 - len(bits).bit_length())  # bits are a power of two, eight a byte
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _key(hashes: np.ndarray, size: int) -> np.ndarray:
    return numtext.mix(hashes + np.uint64(size))


def frequent(texts: DataFrame, size: int, known: np.ndarray, ranges: int, least: int) -> np.ndarray:
    """A bitmap, by hash, of the windows of ``size`` words that occur ``least`` times or more, and of all that ``known`` has.

    Only windows are counted whose first and last words, one less than all, are in ``known``. The bitmap may have windows
    that are not frequent but never lacks one that is. Its size is fixed, so it may go to all tasks.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def spread(batches):
        runs = counting.Runs(ranges, HELD)
        for _, words in _words(batches):
            h, at = words.windows(size)
            if size > 1:
                part, part_at = words.windows(size - 1)
                some = np.zeros(len(words.hashes) + 1, bool)
                some[part_at] = _may_be(shared.value, _key(part, size - 1))
                h = h[some[at] & some[at + 1]]
            yield from runs.add(_key(h, size))
        yield from runs.rest()

    found = counting.table_of(texts, spread, ranges, 1 << FILTER_BITS, lambda n: (n >= least).astype(np.uint8), bits=True)
    shared.unpersist()
    return found | known


# Counts


_COUNTED = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64())])
_SUMS = pa.schema([("at", pa.int64()), ("key", pa.int64()), ("a", pa.int64())])


def _summed(keys: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts added up, and the least text each occurs in."""
    order = np.argsort(keys, kind="stable")
    keys, n, at = keys[order], n[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], np.add.reduceat(n, first), np.minimum.reduceat(at, first)) if len(keys) else (keys, n, at)


class _Sums:
    """Counts of a task by the hash of a phrase, passed on as packed runs, one for each range of hashes."""

    def __init__(self, ranges: int) -> None:
        self.bits = ranges.bit_length() - 1
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(_summed(keys, n, at))
        self.size += len(self.held[-1][0])
        if self.size >= PHRASES:
            self.held = [_summed(*map(np.concatenate, zip(*self.held)))]
            self.size = len(self.held[0][0])
            if self.size >= PHRASES // 2:
                yield from self.rest()
                self.held, self.size = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, n, at = _summed(*map(np.concatenate, zip(*self.held)))
            home = keys >> np.uint64(64 - self.bits)
            first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist()
            packed = [[x[i:j].tobytes() for i, j in zip(first, [*first[1:], len(keys)])] for x in (keys, n, at)]
            kinds = [pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((home[first].tolist(), *packed), kinds)], names=["range", "keys", "n", "at"])


def _phrases(own: Words, bits: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word and size of each phrase that may be frequent; for each word the empty one too."""
    keys, firsts = [_key(own.salt[own.rows], 0)], [np.arange(len(own.rows))]
    for size in range(1, longest + 1):
        h, at = own.windows(size)
        key = _key(h, size)
        ok = _may_be(bits, key)
        keys.append(key[ok])
        firsts.append(at[ok])
    return np.concatenate(keys), np.concatenate(firsts), np.repeat(np.arange(longest + 1), [len(x) for x in keys])


def counts(texts: DataFrame, known: Broadcast, ranges: int, least: int, longest: int) -> DataFrame:
    """``lang, words, a``: how often each phrase of ``least`` occurrences or more occurs; the empty one is all words.

    Counts are added up by 64-bit hash. Only then phrases are spelled, each once, from the text of the least hash that holds
    it. Such texts are few, as those of low hashes hold most phrases. Copies of a text are taken as one.
    """
    rows = texts.withColumn("at", F.xxhash64("lang", "text"))

    def spread(batches):
        sums = _Sums(ranges)
        for batch, own in _words(batches):
            keys, first, _ = _phrases(own, known.value, longest)
            yield from sums.add(keys, np.ones(len(keys), np.int64), batch.column("at").to_numpy(zero_copy_only=False)[own.rows[first]])
        yield from sums.rest()

    def gather(batches):
        now, held = None, []

        def done():
            keys, n, at = _summed(*(np.frombuffer(b"".join(x), k) for x, k in zip(zip(*held), ("<u8", "<i8", "<i8"))))
            often = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (at, keys.view(np.int64), n)], schema=_SUMS)

        for batch in batches:
            for r, *run in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "n", "at"))):
                if r != now and held:
                    yield done()
                    held = []
                now = r
                held.append(run)
        if held:
            yield done()

    def spell(batches):
        for batch, own in _words(batches):
            asked, a = (x.to_numpy(zero_copy_only=False) for x in batch.column("asked").flatten().flatten())
            keys, first, size = _phrases(own, known.value, longest)
            keys, some = np.unique(keys, return_index=True)
            asked = asked.view(np.uint64)
            at = np.searchsorted(keys, asked)
            hit = keys[np.minimum(at, len(keys) - 1)] == asked if len(keys) else np.zeros(len(asked), bool)
            langs, some = batch.column("lang").to_pylist(), some[at[hit]]
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[i] for i in own.rows[first[some]].tolist()], pa.string()),
                pa.array([own.text(i, k) for i, k in zip(first[some].tolist(), size[some].tolist())], pa.list_(pa.string())),
                pa.array(a[hit], pa.int64()),
            ], schema=_COUNTED)

    runs = rows.mapInArrow(trimmed(spread), "range int, keys binary, n binary, at binary").repartitionById(ranges, "range").sortWithinPartitions("range")
    sums = runs.mapInArrow(trimmed(gather), "at long, key long, a long")
    asked = materialise(sums.groupBy("at").agg(F.collect_list(F.struct("key", "a")).alias("asked")), "asked")
    kinds = rows.groupBy("at").agg(F.collect_set(F.struct("lang", "text")).alias("kinds"))  # copies become one before they are shuffled
    return kinds.join(asked, "at").select("asked", F.inline("kinds")).mapInArrow(trimmed(spell), "lang string, words array<string>, a long")


# Streams in order


_SCANNED = "part int, kind string, lang string, words array<string>, a long, chain array<long>, more long"


def in_order(rows: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The rows ``lang, words, a`` with ``chain``, the counts of all beginnings of ``words`` from none to itself, and ``more``.

    ``more`` is the highest count of a phrase with one word after these. The rows are sorted by range, so the phrases
    of one word may lie in several tasks. Each tells with which open phrases it ends, a row a task; so those that follow
    learn the counts of beginnings that lie before them, and extensions found behind a border go back to their
    phrase. ``carried`` columns stay as they are.
    """
    carried = carried or []
    schema = rows.select("lang", "words", "a", *carried).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stack: list[list] = []  # key, count or None, more, carried
        out: list[tuple] = []
        fields = []

        def popped() -> None:
            key, a, more, rest = stack.pop()
            chain = [x[1] for x in stack] + [a]
            out.append((part, "row" if a is not None else "hole", key[0], list(key[1:]), a, chain, more, *rest))

        def batch_of() -> pa.RecordBatch:
            names = ["part", "kind", "lang", "words", "a", "chain", "more", *carried]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64(), *fields]
            columns = list(zip(*out)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            fields = [batch.schema.field(c).type for c in carried]
            for lang, words, a, *rest in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "a", *carried))):
                key = (lang, *words)
                while stack and (len(stack) >= len(key) or stack[-1][0] != key[: len(stack)]):
                    popped()
                while len(stack) < len(key) - 1:  # begins in an earlier task
                    stack.append([key[: len(stack) + 1], None, None, [None] * len(carried)])
                if stack:
                    stack[-1][2] = max(a, stack[-1][2] or 0)
                stack.append([key, a, None, rest])
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if stack:
            key, chain = stack[-1][0], [x[1] for x in stack]
            while stack:
                popped()
            out.append((part, "end", key[0], list(key[1:]), None, chain, None, *[None] * len(carried)))
        if out:
            yield batch_of()

    ranged = rows.select("lang", "words", "a", *carried).repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields[3:])
    scanned = materialise(ranged.mapInArrow(trimmed(task), _SCANNED + (f", {kinds}" if kinds else "")), "count-stream")
    before, opened = {}, []
    for part, chain in sorted(scanned.filter("kind = 'end'").select("part", "chain").collect()):
        before[part] = opened
        opened = [x if x is not None else opened[i] for i, x in enumerate(chain)]
    spark = rows.sparkSession
    borders = spark.createDataFrame([*before.items()], "part int, before array<long>")
    holes = scanned.filter("kind = 'hole'").groupBy("lang", "words").agg(F.max("more").alias("behind"))
    whole = scanned.filter("kind = 'row'").join(F.broadcast(borders), "part").join(holes, ["lang", "words"], "left")
    chain = F.transform("chain", lambda x, i: F.coalesce(x, F.get("before", i)))
    return whole.select("lang", "words", "a", chain.alias("chain"), F.greatest("more", "behind").alias("more"), *carried)


# Phrases


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, words, a, n, lefts, rights, more``: frequent phrases of two words or more with the counts of their parts.

    ``lefts[i]`` counts the first i words and ``rights[i]`` the last i, both from none; ``more`` is the highest count of a
    phrase that holds this one and one word more.
    """
    with small_batches(docs.sparkSession):
        texts = _texts(docs)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = counting.ranges_for(size // 6, bits=FILTER_BITS)  # of about so many words
        known = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for order in range(1, longest + 1):
            known = frequent(texts, order, known, ranges, least)
        counted = materialise(counts(texts, docs.sparkSession.sparkContext.broadcast(known), ranges, least, longest), "counts")
        backward = in_order(counted.withColumn("words", F.reverse("words")))
        backward = backward.select("lang", F.reverse("words").alias("words"), "a", F.col("chain").alias("rights"), F.col("more").alias("left_more"))
        both = in_order(backward, ["rights", "left_more"])
    return both.filter(F.size("words") > 1).select("lang", "words", "a", F.get("chain", F.lit(0)).alias("n"), F.col("chain").alias("lefts"), "rights", F.greatest("more", "left_more").alias("more"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), in whole numbers of up to 38 digits."""
    exact = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(left) * exact(right)
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose parts attract each other most.

    A null text has no words and a null language is ``und``. The score is that of the weakest cut. A phrase that never
    occurs but within a longer one is left out; as parts of a phrase occur at least as often, one word more decides it.
    """
    found = candidates(docs, least, longest)
    cut = lambda k: F.struct(
        _score(F.col("a"), F.col("n"), F.get("lefts", k), F.get("rights", F.size("words") - k)).alias("score"), k.alias("k"),
        F.get("lefts", k).alias("l"), F.get("rights", F.size("words") - k).alias("r"),
    )
    found = found.filter(F.coalesce(F.col("more"), F.lit(0)) < F.col("a"))
    found = found.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)))
    found = found.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, unnest([w[i : i + k] FOR k IN range(0, least(5, len(w) - i + 1))]) AS g FROM starts
), f AS (
  SELECT lang, g, count(*) AS a FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY ALL
), candidates AS (
  SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= 100
), cuts AS (
  SELECT c.lang, c.g, c.a, x.a AS l, y.a AS r, n, k, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM candidates c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, a, unnest(range(2, len(g))) AS size FROM f WHERE len(g) > 2 AND a >= 100
), inside AS (
  SELECT lang, unnest([g[i : i + size - 1] FOR i IN range(1, len(g) - size + 2)]) AS g, a FROM longer
), kept AS (
  SELECT l.* FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = l.lang AND i.g = l.g AND 100 * i.a >= 100 * l.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
