"""Benchmark passages in documents: SimHash windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.registry import query, table
from concord.session import materialise

SHINGLE = 5
PERCENT = 75
#: 128 bits in 8 blocks of 16; 3 flips a block. Fingerprints within 8 * (3 + 1) - 1 bits agree in a block up to 3 flips.
BLOCKS, BLOCK_BITS, FLIPS = 8, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1


def _words(text: str) -> Column:
    """Runs of letters and digits in lower case, so that marks and case around a passage do not hide it."""
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _grams(words: str, k: int, n: Column) -> Column:
    """Hashes of every ``k`` words in a row; none if there are fewer."""
    one = lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(words), i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def _bag(words: str) -> Column:
    """Shingles of a passage, repeats numbered, so that set operations weigh a shingle by its count.

    A passage of fewer than five words is one shingle.
    """
    n = F.size(words)
    plain = F.when(n >= SHINGLE, _grams(words, SHINGLE, n)).otherwise(F.array(F.xxhash64(F.lit(0), words)))
    number = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x))))
    return _bound(plain, number)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once; named columns would be put in place again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _simhash(bag: str) -> Column:
    """Blocks of the fingerprint: a bit is set where more than half of the shingles have it."""

    votes = lambda values, b: F.aggregate(values, F.lit(0), lambda n, x: n + F.getbit(x, b) * 2 - 1)
    block = lambda values, at: F.aggregate(
        F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)), F.lit(0), lambda out, b: out * 2 + F.when(votes(values, at * BLOCK_BITS + b) > 0, 1).otherwise(0)
    )
    half = lambda values: F.transform(F.sequence(F.lit(0), F.lit(64 // BLOCK_BITS - 1)), lambda i: block(values, i))
    return F.concat(half(F.col(bag)), _bound(F.transform(F.col(bag), lambda x: F.xxhash64(x, F.lit(7))), half))


def _prints(df: DataFrame, *keys: str) -> DataFrame:
    bagged = materialise(df.select(*keys, _bag("words").alias("bag")), "bags")
    return bagged.select(*keys, "bag", _simhash("bag").alias("print"))


def passages(benchmark: DataFrame) -> DataFrame:
    """Items with words: ``item, item_id, n_words, words``, one row per distinct row; ``item`` names it, as ids may be
    null or repeat. Items without words match nothing."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words"))
    return own.filter(F.size("words") > 0).distinct().withColumns(
        {"n_words": F.size("words"), "item": F.xxhash64(F.col("item_id").isNull(), F.coalesce("item_id", F.lit(0)), "words")}
    )


def _row_keys() -> list[Column]:
    return [F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.xxhash64("text")]


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*[k.alias(c) for k, c in zip(_row_keys(), _ROW)], *more)


_ROW = ["id_hash", "text_hash"]


def item_sized_windows(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every window as long as an item that can reach ``percent`` similarity to an item of this length.

    A window and an item share at most as many shingles as the window has places whose shingle lies in an item of
    its length. Windows with too few such places for ``percent`` are never formed, all others are, in whatever order
    the parts of a passage come. A document that is shorter than the item is one window. Returns ``id_hash,
    text_hash, start, n_words``.
    """
    sizes = sorted(r.k for r in items.select(F.least(F.lit(SHINGLE), "n_words").alias("k")).distinct().collect())
    found = []
    for k in sizes:
        own = items.filter(F.col("n_words") >= k if k == SHINGLE else F.col("n_words") == k)
        anchors = own.select(F.col("n_words").alias("size"), F.explode(_grams("words", k, F.size("words"))).alias("gram"))
        anchors = materialise(anchors.distinct(), "anchors")
        shaped = _keyed(docs, _words("text").alias("words")).withColumn("n", F.size("words"))
        grams = shaped.select(*_ROW, "n", F.posexplode(_grams("words", k, F.col("n"))).alias("place", "gram"))
        hits = grams.join(anchors, "gram").groupBy(*_ROW, "n", "size").agg(F.sort_array(F.collect_set("place")).alias("at"))
        # of ``size`` words, ``long`` in a document of fewer; ``need`` hits among ``long - k + 1`` places can reach percent
        hits = hits.withColumn("long", F.least("n", "size"))
        need = F.ceil((F.col("long") + F.col("size") - 2 * k + 2) * percent / F.lit(100 + percent)).cast("int")
        hits = hits.withColumn("need", F.greatest(F.lit(1), need)).filter(F.size("at") >= F.col("need"))
        # a window that holds the hits i to i + need - 1 begins within a stretch; stretches go up and do not overlap
        low = lambda i: F.greatest(
            F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("long") + k, F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0)
        )
        high = lambda i: F.least(F.get("at", i), F.col("n") - F.col("long"))
        stretch = lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>"))
        starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), stretch))
        found.append(hits.select(*_ROW, F.explode(starts).alias("start"), F.col("long").alias("n_words")))
    if not found:
        return _keyed(docs, F.lit(0).alias("start"), F.lit(0).alias("n_words")).limit(0)
    return reduce(DataFrame.unionAll, found).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents that hold a benchmark item: one row per pair, with the best window.

    ``doc_id, item_id, start_word, n_words, shared, total``: 100 * shared >= percent * total, in shingles of
    five words weighed by their counts. Null and empty texts and items match nothing; rows that repeat give one
    row; a document without an id is reported with a null id. Fingerprints of windows and items within ``RADIUS``
    bits are all found, as they agree in one block up to three flips; flips are taken on the side of the items.
    Equal windows of many documents are searched and verified once.
    """
    cut, held = _found(docs, benchmark, percent)
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("s"), (-F.col("start")).alias("at"), "n_words", "shared", "total"))
    return (
        cut.join(held, ["w1", "w2"]).groupBy("doc_id", "item_id").agg(best.alias("m"))
        .select("doc_id", "item_id", (-F.col("m.at")).cast("long").alias("start_word"), F.col("m.n_words").cast("long").alias("n_words"),
                F.col("m.shared").cast("long").alias("shared"), F.col("m.total").cast("long").alias("total"))
    )


def _found(docs: DataFrame, benchmark: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Windows of rows, and the windows that hold an item: ``id_hash, text_hash, doc_id, start, n_words, w1, w2`` and ``w1, w2, item_id, shared, total``."""
    items = materialise(passages(benchmark), "items")
    spans = materialise(item_sized_windows(docs, items, percent), "spans")
    per_doc = materialise(spans.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "n_words")).alias("spans")), "marked")
    shaped = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_doc, _ROW)
    shaped = shaped.select(*_ROW, "doc_id", _words("text").alias("all"), F.explode("spans").alias("span"))
    cut = shaped.select(*_ROW, "doc_id", "span.start", "span.n_words", F.slice("all", F.col("span.start") + 1, F.col("span.n_words")).alias("words"))
    cut = materialise(cut.withColumns({"w1": F.xxhash64("words"), "w2": F.xxhash64(F.lit(1), "words")}).distinct(), "windows")

    kinds = materialise(_prints(cut.groupBy("w1", "w2").agg(F.first("words").alias("words")), "w1", "w2"), "kinds")
    marked = materialise(_prints(items, "item", "item_id"), "prints").withColumnRenamed("bag", "item_bag").withColumnRenamed("print", "item_print")
    spark = docs.sparkSession
    flips = spark.range(1 << BLOCK_BITS).filter(F.bit_count("id") <= FLIPS).select(F.col("id").cast("int").alias("flip"))
    flips = F.array(*[F.lit(r.flip) for r in flips.collect()])
    near = marked.select("item", F.posexplode("item_print").alias("block", "value"))
    # flips multiply the items some 700 times, which Spark's size estimate does not see: never broadcast them
    near = near.select("item", "block", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    pairs = kinds.select("w1", "w2", F.posexplode("print").alias("block", "value")).join(near.hint("merge"), ["block", "value"]).select("w1", "w2", "item").distinct()

    both = materialise(pairs, "candidates").join(kinds, ["w1", "w2"]).join(marked, "item")
    apart = F.aggregate(F.zip_with("print", "item_print", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    both = both.withColumn("shared", F.size(F.array_intersect("bag", "item_bag"))).withColumn("total", F.size("bag") + F.size("item_bag") - F.col("shared"))
    held = both.filter(apart <= RADIUS).filter(F.col("shared") * 100 >= F.col("total") * percent)
    return cut, materialise(held.select("w1", "w2", "item_id", "shared", "total"), "verified")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no item.

    Each row is judged by its own text: of rows that share an id, or have none, only those with an item go.
    """
    cut, held = _found(docs, benchmark, PERCENT)
    hits = cut.join(held.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi").select(*[F.col(c).alias(f"_{c}") for c in _ROW])
    hits = materialise(hits.distinct(), "hits")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[k.alias(f"_own_{c}") for k, c in zip(_row_keys(), _ROW)])
    kept = keyed.join(hits, (F.col("_own_id_hash") == F.col("_id_hash")) & (F.col("_own_text_hash") == F.col("_text_hash")), "left_anti")
    return kept.drop("_own_id_hash", "_own_text_hash")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
