"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import numtext
from concord.llm.registry import fold, give_back, query, small_batches, table, trimmed
from concord.session import materialise

# Document statistics


_KIND = np.zeros(256, np.uint8)
_KIND[[*range(97, 123)]] = 1  # small letters
_KIND[[*range(65, 91)]] = 2  # capitals
_KIND[[*range(48, 58)]] = 3  # digits
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4  # ASCII marks
_KIND[list(numtext.SPACES)] = 5
_KIND[128:192] = 6  # within a character
_KIND[192:] = 7  # first byte of a character
#: Marks that are counted one by one.
MARKS = "#*$%&|<>!?.,;:@/_-=+()[]{}\"'\\~^`"


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text, of its characters, words, lines and repetitions alone."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    bytes_ = numtext.byte_counts(data, offsets)
    small, large, digit, mark, space, inner, lead = (bytes_[:, _KIND == k].sum(1) for k in range(1, 8))
    chars = np.maximum(size - inner, 1)
    letters = np.maximum(small + large + lead, 1)
    starts, ends, row = numtext.words(data, offsets)
    n = np.bincount(row, minlength=rows).astype(float)
    words = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    per = lambda w: np.bincount(row, w, rows)
    own = numtext.hashes(data, starts, ends, lower=True)
    salt = numtext.row_salt(rows)

    def distinct(values: np.ndarray, rows_of: np.ndarray) -> np.ndarray:
        keys, at = np.unique(numtext.mix(values ^ salt[rows_of]), return_index=True)
        return np.bincount(rows_of[at], minlength=rows).astype(float)

    pairs, pair_at = numtext.windows(own, row, 2)
    threes, three_at = numtext.windows(own, row, 3)
    line_start, line_end, line_row = numtext.runs(data != 10, offsets)
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1).astype(float)
    line_kinds = distinct(numtext.hashes(data, line_start, line_end), line_row)
    first, last = data[starts], data[ends - 1]
    share = lambda x, y: x / np.maximum(y, 1)
    features = [
        np.log1p(size), np.log1p(n), np.log1p(lines), share(n, lines),
        per(length) / words, np.sqrt(np.maximum(per(length**2) / words - (per(length) / words) ** 2, 0)), per(length > 20) / words, per(length == 1) / words,
        small / chars, large / letters, digit / chars, mark / chars, space / chars, lead / chars,
        per(_KIND[first] == 2) / words, per(_KIND[first] == 4) / words, per(_KIND[last] == 4) / words, per((_KIND[first] == 4) & (length == 1)) / words,
        share(distinct(own, row), n), share(distinct(pairs, row[pair_at]), n), share(distinct(threes, row[three_at]), n), share(line_kinds, lines),
    ]
    features += [bytes_[:, ord(m)] / words for m in MARKS]
    return np.stack(features, 1)


# Trees


@dataclass
class Trees:
    """Flat arrays over all nodes: a leaf points to itself."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees of all rows go down a level at a time."""
        b = self.binned(x)
        at = np.broadcast_to(self.roots, (len(b), len(self.roots)))
        rows = np.arange(len(b))[:, None]
        for _ in range(self.depth):
            at = self.child[at, (b[rows, self.feature[at]] > self.bin[at]).astype(np.int8)]
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees on the logistic loss; splits are found in histograms of gradients by bin.

    With no rows, or one label alone, the score is a constant near the share of label 1.
    """
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(edges, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0), np.zeros(0, np.int64), depth, float(np.log(mean / (1 - mean))))
    feature, cut, child, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(0), child.append([len(child)] * 2), value.append(0.0)
        return len(value) - 1

    if 0 < y.sum() < len(y):
        b, m = model.binned(x).astype(np.int64), x.shape[1]
        flat = b + np.arange(m) * bins
        score = np.full(len(y), model.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            root = node()
            roots.append(root)
            open_ = [(root, np.arange(len(y)))]
            for level in range(depth + 1):
                next_ = []
                for at, rows in open_:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    best = None
                    if level < depth and len(rows) >= 2 * least:
                        keys = flat[rows].ravel()
                        sums = [np.bincount(keys, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
                        left_g, left_h, left_n = sums
                        gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                        gain[(left_n < least) | (len(rows) - left_n < least)] = 0
                        place = int(gain.argmax())
                        if gain.flat[place] > 1e-6:
                            best = divmod(place, bins - 1)
                    if best is None:
                        value[at] = -rate * total_g / (total_h + l2)
                        score[rows] += value[at]
                        continue
                    feature[at], cut[at] = best
                    right = b[rows, best[0]] > best[1]
                    child[at] = [node(), node()]
                    next_ += [(child[at][0], rows[~right]), (child[at][1], rows[right])]
                open_ = next_
    model.feature, model.bin = np.array(feature, np.int64), np.array(cut, np.int64)
    model.child, model.value, model.roots = np.array(child, np.int64).reshape(-1, 2), np.array(value), np.array(roots, np.int64)
    return model


# On Spark


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` training documents, those whose ids hash lowest.

    ``sample`` bounds what is broadcast (an id and a label a row) and what the driver gets (under 500 bytes a row). Only
    rows off the held-out fold count. A document with several labels takes the least; a null label is none. Of several
    rows of an id that one counts whose text has the least hash.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in numtext.slices(batch.column("text")):
                x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(data, offsets).ravel()), _width()).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), x], names=["label", "x"])

    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label is not null and doc_id is not null")
    train = train.filter(~fold("doc_id", 3, 1)).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(train), "doc_id")
    mark = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    one = known.groupBy("doc_id").agg(F.min(mark).alias("least")).withColumnRenamed("doc_id", "id")
    own = known.join(F.broadcast(one), (F.col("doc_id") == F.col("id")) & (mark == F.col("least")))
    own = own.groupBy("doc_id", "label").agg(F.first("text").alias("text"))  # rows that are left have the same text
    got = own.select("label", "text").mapInArrow(trimmed(task), "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, _width())
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in no fixed order; sums must not depend on it
    return x[order], y[order]


def _width() -> int:
    return 22 + len(MARKS)


def scorer(model: Trees):
    """A column function: the score of a text; null and empty texts have the score of no text."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in texts:
            parts = [model.score(statistics(data, offsets)) for _, _, data, offsets in numtext.slices(values)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        give_back()

    return score


def trained(docs: DataFrame, labels: DataFrame) -> Trees:
    return fit(*labelled_statistics(docs, labels))


def with_score(docs: DataFrame, model: Trees, out: str) -> DataFrame:
    return docs.withColumn(out, scorer(model)(F.col("text").cast("string")))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is at least ``least``."""
    with small_batches(docs.sparkSession):
        scored = with_score(docs, trained(docs, labels), "quality score of this stage")
        kept = scored.filter(F.col("`quality score of this stage`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
        return materialise(kept, "accepted")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; a row without id is held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(texts, trained(docs, labels), "score")
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))



@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
