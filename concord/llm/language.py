"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import numtext, store, succinct
from concord.llm.registry import fold, query, table
from concord.session import materialise, scratch_path

ORDER = 4
UNKNOWN = "und"
_SPACE = 32
#: Bytes of a file of the models, or so.
SHARD = 1 << 26


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A 16-bit symbol for every code point: small letters as they are, everything else a space."""
    out = np.full(0x110000, _SPACE, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low if low < 0x10000 else 0xE000 | (low & 0x1FFF)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each letter or gap of the texts with the three before it, packed into 64 bits, and its row.

    A run of other characters is one gap; a text begins with gaps. A text without letters gives nothing.
    """
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(rows), np.diff(first))
    sym = _symbols()[points]
    letters = np.bincount(row, sym != _SPACE, rows)
    before = np.full(len(sym), _SPACE, np.uint16)
    if len(sym):
        before[1:] = np.where(row[1:] == row[:-1], sym[:-1], _SPACE)
    keep = ((sym != _SPACE) | (before != _SPACE)) & (letters[row] > 0)
    sym, row = sym[keep].astype(np.uint64), row[keep]
    code = sym.copy()
    for back in range(1, ORDER):
        prior = np.full(len(sym), _SPACE, np.uint64)
        if back < len(sym):
            prior[back:] = np.where(row[back:] == row[:-back], sym[:-back], np.uint64(_SPACE))
        code |= prior << np.uint64(16 * back)
    return code, row


class HashArray:
    """Keys as sorted 64-bit hashes, with the place where each run of leading bits begins."""

    def __init__(self, keys: np.ndarray):
        hashed = numtext.mix(keys)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the sorted hashes, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        hashed = numtext.mix(keys)
        top = (hashed >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        live = np.flatnonzero(at < end)
        at, end, hashed = at[live], end[live], hashed[live]
        while len(live):
            hit = self.hashes[at] == hashed
            out[live[hit]] = at[hit]
            go = ~hit & (at + 1 < end)
            live, at, end, hashed = live[go], at[go] + 1, end[go], hashed[go]
        return out


@lru_cache(maxsize=4096)
def _opened(uri: str) -> tuple[HashArray, np.ndarray]:
    held = succinct.read_bundle(uri)
    names = HashArray.__new__(HashArray)
    names.hashes, names.first, names.shift = held["hash"], held["first"], np.uint64(held["shift"][0])
    return names, held["value"].reshape(len(names.hashes), -1)


def _shard_bits(code: np.ndarray) -> np.ndarray:
    """Xorshift, which Spark computes alike (``_shard``)."""
    code = code ^ (code << np.uint64(13))
    code = code ^ (code >> np.uint64(7))
    return code ^ (code << np.uint64(17))


class Stored:
    """Hash arrays in memory-mapped files, one a shard; both the keys and their rows of values."""

    def __init__(self, files: list[str], sizes: list[int], langs: int):
        self.files, self.langs = files, langs
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key over all shards, or -1."""
        out = np.full(len(keys), -1, np.int64)
        shard = ((_shard_bits(keys) >> np.uint64(32)) & np.uint64(len(self.files) - 1)).astype(np.int64)
        for s, own in self._by_shard(shard):
            if self.base[s] < self.base[s + 1]:
                at = _opened(self.files[s])[0].find(keys[own])
                out[own] = np.where(at >= 0, at + self.base[s], -1)
        return out

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), self.langs), np.float32)
        for s, own in self._by_shard(np.searchsorted(self.base, places, "right") - 1):
            out[own] = _opened(self.files[s])[1][places[own] - self.base[s]]
        return out

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(len(self.files) + 1))
        return ((s, order[ends[s] : ends[s + 1]]) for s in range(len(self.files)) if ends[s] < ends[s + 1])


@dataclass
class Models:
    """All languages together: per level the grams any language has, and their log probability in each."""

    langs: list[str]
    grams: list[HashArray | Stored]
    logs: list[np.ndarray | Stored]
    contexts: list[HashArray | Stored]
    weights: list[np.ndarray | Stored]
    floor: float

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """One row per gram, one column per language; what a level lacks is asked of the next, shorter one."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        live = np.arange(len(code))
        for level in range(ORDER, 0, -1):
            key = code[live] & _mask(level)
            at = self.grams[level].find(key)
            hit = at >= 0
            out[live[hit]] += self.logs[level][at[hit]]
            live, key = live[~hit], key[~hit]
            if len(live):
                place = self.contexts[level].find(key >> np.uint64(16))
                known = place >= 0
                out[live[known]] += self.weights[level][place[known]]
        out[live] += self.floor
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and the cross-entropy per symbol under each language."""
        rows = len(offsets) - 1
        code, row = grams(data, offsets)
        n = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.langs)))
        if len(code):
            some = np.flatnonzero(n)
            sums = np.add.reduceat(self.log_probability(code), np.searchsorted(row, some), axis=0, dtype=np.float64)
            out[some] = -sums / n[some, None]
        return n, out


def _mask(level: int) -> np.uint64:
    return np.uint64((1 << (16 * level)) - 1)


def _reduced(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's highest-order grams and counts.

    Lower orders count in how many different grams a shorter one is the end (Kneser-Ney); every order takes
    a discount off each count and gives it to the next lower order, the lowest to a uniform share.
    """
    langs = sorted(counts)
    levels: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for lang in langs:
        keys, n = _reduced(*counts[lang])
        levels[lang] = {ORDER: (keys, n.astype(float))}
        for level in range(ORDER - 1, 0, -1):
            keys, n = _reduced(levels[lang][level + 1][0] & _mask(level), np.ones(len(levels[lang][level + 1][0])))
            levels[lang][level] = keys, n
    floor = -16 * np.log(2)
    out = Models(langs, [None], [None], [None], [None], float(floor))
    lower_keys, lower = np.zeros(1, np.uint64), np.full((1, len(langs)), floor)
    for level in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([levels[x][level][0] for x in langs])) if langs else np.zeros(0, np.uint64)
        context = keys >> np.uint64(16)
        heads = np.unique(context)
        low = lower[np.searchsorted(lower_keys, keys & _mask(level - 1)) if level > 1 else np.zeros(len(keys), np.int64)]
        logs, weights = np.zeros((len(keys), len(langs))), np.zeros((len(heads), len(langs)))
        for i, lang in enumerate(langs):
            own, n = levels[lang][level]
            one, two = (n == 1).sum(), (n == 2).sum()
            off = one / (one + 2 * two) if one and two else 0.75
            head = np.searchsorted(heads, own >> np.uint64(16))
            total = np.bincount(head, n, len(heads))
            left = np.bincount(head, np.minimum(n, off), len(heads))
            weight = np.where(total > 0, left / np.maximum(total, 1), 1.0)
            weights[:, i] = np.log(weight)
            at = np.searchsorted(heads, context)
            p = weight[at] * np.exp(low[:, i])
            mine = np.searchsorted(keys, own)
            p[mine] += np.maximum(n - off, 0) / total[head]
            logs[:, i] = np.log(p)
        names, before = HashArray(keys), HashArray(heads)
        out.grams.append(names)
        out.logs.append(logs[names.order].astype(np.float32))
        out.contexts.append(before)
        out.weights.append(weights[before.order].astype(np.float32))
        lower_keys, lower = keys, logs
    return out


# On Spark


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, code, n`` over all training documents, counted in tasks before they are shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            return _reduced(np.concatenate([k for k, _ in held[lang]]), np.concatenate([n for _, n in held[lang]]))

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, data, offsets in numtext.slices(batch.column("text")):
                code, row = grams(data, offsets)
                own = langs[a:b][row]
                for lang in set(langs[a:b]):
                    keys, n = np.unique(code[own == lang], return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
                if size > 1 << 22:
                    held.update({lang: [merged(lang)] for lang in held})
                    size = sum(len(x[0][0]) for x in held.values()) // 2
        for lang in held:
            keys, n = merged(lang)
            for a in range(0, len(keys), 1 << 17):
                part = keys[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[a : a + (1 << 17)])], names=["lang", "code", "n"])

    train = docs.filter("lang is not null and text is not null").filter(~fold("doc_id", 4, 2))
    texts = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(task, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _shard(code: Column, shards: int) -> Column:
    for turn, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        code = code.bitwiseXOR(turn(code, by))
    return F.shiftrightunsigned(code, 32).bitwiseAND(F.lit(shards - 1)).cast("int")


def _per_language(df: DataFrame, key: str, langs: int, value: Column, missing: Column) -> DataFrame:
    """One row per ``key``, with an array of ``value`` for all languages."""
    held = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", value.alias("value")))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(langs - 1)), lambda i: F.coalesce(F.try_element_at("held", i), missing))
    return held.select(key, every.alias("by_lang"))


def trained(docs: DataFrame, folder: str | None = None) -> Models:
    """Models of all languages from every gram of the training texts: ``build`` as aggregations and joins of Spark.

    The hash arrays are files in the shared folder, ``SHARD`` bytes or so each, which scoring maps into memory. Only
    the languages, four discounts for each, and the names of files reach the driver.
    """
    folder = folder or scratch_path(docs.sparkSession, "models")
    counted = materialise(gram_counts(docs), "grams")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return build({})
    places = docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, i int")
    levels = {ORDER: materialise(counted.join(places, "lang").select("i", "code", "n"), "level")}
    for level in range(ORDER - 1, 0, -1):
        shorter = F.col("code").bitwiseAND(F.lit(int(_mask(level)))).alias("code")
        levels[level] = materialise(levels[level + 1].select("i", shorter).groupBy("i", "code").agg(F.count(F.lit(1)).alias("n")), "level")

    floor, parts, lower = -16 * np.log(2), [], None
    for level in range(1, ORDER + 1):
        few = levels[level].groupBy("i").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
        off = F.when((F.col("one") > 0) & (F.col("two") > 0), F.col("one") / (F.col("one") + 2 * F.col("two"))).otherwise(F.lit(0.75))
        offs = {r.i: r.off for r in few.select("i", off.alias("off")).collect()}
        off = F.get(F.array(*[F.lit(offs.get(i, 0.75)) for i in range(len(langs))]), F.col("i"))
        own = levels[level].select("i", "code", F.col("n").cast("double").alias("n"), F.shiftrightunsigned("code", 16).alias("head"), off.alias("off"))
        total = own.groupBy("i", "head").agg(F.sum("n").alias("total"), F.sum(F.least("n", "off")).alias("left"))
        nothing = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("total"))
        heads = _per_language(total, "head", len(langs), F.struct((F.col("left") / F.col("total")).alias("weight"), F.col("total")), nothing)
        heads = materialise(heads.withColumnRenamed("by_lang", "context"), "contexts")
        taken = own.select("i", "code", F.greatest(F.col("n") - F.col("off"), F.lit(0.0)).alias("n"))
        keys = _per_language(taken, "code", len(langs), F.col("n"), F.lit(0.0)).withColumn("head", F.shiftrightunsigned("code", 16))
        if level == 1:  # one context, the empty one
            keys = keys.join(F.broadcast(heads), "head").withColumn("low", F.array_repeat(F.lit(float(np.exp(floor))), len(langs)))
        else:
            keys = keys.withColumn("shorter", F.col("code").bitwiseAND(F.lit(int(_mask(level - 1)))))
            keys = keys.join(heads, "head").join(lower.select(F.col("code").alias("shorter"), F.col("p").alias("low")), "shorter")
        mixed = F.zip_with("by_lang", F.zip_with("context", "low", lambda c, q: F.struct(c.weight.alias("weight"), c.total.alias("total"), q.alias("low"))),
                           lambda n, c: n / c.total + c.weight * c.low)
        lower = materialise(keys.select("code", mixed.alias("p")), "level")
        logs = lambda a: F.transform(a, lambda x: F.log(x).cast("float")).alias("value")
        parts.append(lower.select(F.lit(2 * level).alias("kind"), "code", logs(F.col("p"))))
        parts.append(heads.select(F.lit(2 * level + 1).alias("kind"), F.col("head").alias("code"), logs(F.col("context.weight"))))

    def written(part: pa.Table) -> pa.Table:
        codes = part.column("code").to_numpy().view(np.uint64)
        values = part.column("value").combine_chunks().flatten().to_numpy().reshape(len(codes), -1)
        names, uri = HashArray(codes), store.new_name(folder, ".grams")
        succinct.write_bundle(uri, {"hash": names.hashes, "first": names.first, "shift": np.array([names.shift]), "value": values[names.order].ravel()})
        return pa.table({"kind": part.column("kind")[:1], "shard": part.column("shard")[:1], "file": [uri], "rows": pa.array([len(codes)], pa.int64())})

    sizes = [x.count() for x in parts]
    most = max(sizes) * (16 + 4 * len(langs))
    shards = max(16, 1 << int(np.ceil(np.log2(max(1, most / SHARD)))))
    every = reduce(DataFrame.unionAll, parts).withColumn("shard", _shard(F.col("code"), shards))
    files = every.groupBy("kind", "shard").applyInArrow(written, "kind int, shard int, file string, rows long")
    made = {(r.kind, r.shard): r for r in materialise(files, "files").collect()}
    out = Models(langs, [None], [None], [None], [None], float(floor))
    for level in range(1, ORDER + 1):
        for kind, names, values in ((2 * level, out.grams, out.logs), (2 * level + 1, out.contexts, out.weights)):
            own = [made.get((kind, s)) for s in range(shards)]
            stored = Stored([r.file if r else "" for r in own], [r.rows if r else 0 for r in own], len(langs))
            names.append(stored)
            values.append(stored)
    return out


def identified(docs: DataFrame, models: Models | None = None, tail: float = 0.001) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted, xent`` per row.

    ``lang_pred`` has the lowest cross-entropy per symbol, the first by name on a tie, or is ``und`` for texts that are
    null or have no letter, and for all if nothing was learned. ``score`` is its share among the languages at
    20 symbols of the text, or as many as it has. ``accepted`` is the calibrated rejection: whether ``xent`` is within
    the range of all but ``tail`` of the training texts of that language. Languages without a name are not
    learned; ids may be null (held out) or repeat.
    """
    models = models or trained(docs)
    shared, langs = docs.sparkSession.sparkContext.broadcast(models), models.langs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in numtext.slices(batch.column("text")):
                n, xent = shared.value.entropies(data, offsets)
                known = (n > 0) & bool(langs)
                best = xent.argmin(1) if langs else np.zeros(b - a, np.int64)
                low = xent[np.arange(b - a), best] if langs else np.zeros(b - a)
                odds = np.exp((low[:, None] - xent) * np.minimum(n, 20)[:, None])
                score = np.where(known, 1 / np.maximum(odds.sum(1), 1), 0.0)
                names = [langs[i] if k else UNKNOWN for i, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out", "lang")], pa.array(names), pa.array(score),
                     pa.array(np.where(known, low, np.nan), mask=~known)], names=["doc_id", "held_out", "lang", "lang_pred", "score", "xent"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", 4, 2).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(task, "doc_id long, held_out boolean, lang string, lang_pred string, score double, xent double")
    rows = materialise(rows, "languages")
    limits = rows.filter("not held_out and lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("xent", 1 - tail, 10_000).alias("most"))
    out = rows.drop("lang").join(F.broadcast(limits) if len(langs) < 10_000 else limits, "lang_pred", "left")
    return out.select("doc_id", "held_out", "lang_pred", "score", F.coalesce(F.col("xent") <= F.col("most"), F.lit(False)).alias("accepted"), "xent")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
