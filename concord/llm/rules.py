"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, a posterior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import numtext
from concord.llm.registry import query, table
from concord.session import materialise

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
BAD, GOOD, ABSTAIN = 0, 1, 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # a letter outside ASCII counts by its first byte
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: what the rules look at."""
    rows = len(offsets) - 1
    seen = numtext.byte_counts(data, offsets)
    spaces = seen[:, list(numtext.SPACES)].sum(1)
    starts, ends, row = numtext.words(data, offsets)
    count = lambda at: np.bincount(at, minlength=rows).astype(np.int64)
    salt = numtext.row_salt(rows)

    nonspace = np.concatenate([[0], np.cumsum(~numtext.IS_SPACE[data])])
    line_start, line_end, line_row = numtext.runs(data != 10, offsets)
    full = nonspace[line_end] > nonspace[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    lines = numtext.mix(numtext.hashes(data, line_start, line_end) ^ salt[line_row])
    _, first = np.unique(lines, return_index=True)

    threes, at = numtext.windows(numtext.hashes(data, starts, ends), row, 3)
    _, which, n = np.unique(numtext.mix(threes ^ salt[row[at]]), return_inverse=True, return_counts=True)
    twice = at[n[which] > 1]
    repeated = np.zeros(len(starts), bool)
    for i in range(3):
        repeated[twice + i] = True
    return {
        "n_words": count(row), "word_chars": seen[:, :128].sum(1) + seen[:, 192:].sum(1) - spaces, "n_symbols": seen[:, list(SYMBOLS)].sum(1),
        "n_dup_lines": count(line_row) - count(line_row[first]), "n_repeat_words": count(row[repeated]), "n_lines": count(line_row),
        "n_letters": seen[:, _LETTER].sum(1), "n_capitals": seen[:, 65:91].sum(1),
        "n_marked_ends": count(row[_MARK[data[ends - 1]]]) if len(ends) else count(row), "n_short_words": count(row[ends - starts <= 3]),
    }


# Rules


def _vote(value: np.ndarray, known: np.ndarray, good: tuple[float, float], bad_below: float, bad_above: float) -> np.ndarray:
    """Good within ``good``, bad beyond the two limits, else, or where nothing is known, no vote."""
    out = np.full(len(value), ABSTAIN, np.int8)
    out[(value >= good[0]) & (value <= good[1])] = GOOD
    out[(value < bad_below) | (value > bad_above)] = BAD
    out[~known] = ABSTAIN
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column per rule."""
    n, none = m["n_words"], np.inf
    some = n > 0
    per = lambda x, y: m[x] / np.maximum(m[y], 1)
    return np.stack([
        _vote(per("word_chars", "n_words"), some, (3, 9), 2, 12),
        _vote(per("n_symbols", "n_words"), some, (0, 0.02), 0, 0.1),
        _vote(per("n_dup_lines", "n_lines"), m["n_lines"] > 2, (0, 0.1), 0, 0.3),
        _vote(per("n_repeat_words", "n_words"), n > 5, (0, 0.1), 0, 0.3),
        _vote(per("n_marked_ends", "n_words"), n > 9, (0, 0.3), 0, 0.5),
        _vote(per("n_capitals", "n_letters"), m["n_letters"] > 0, (0, 0.15), 0, 0.4),
        _vote(per("n_short_words", "n_words"), n > 9, (0.1, 0.6), 0.02, 0.8),
        _vote(per("n_letters", "word_chars"), some, (0.8, none), 0.6, none),
        _vote(n.astype(float), np.ones(len(n), bool), (50, none), 10, none),
    ], 1)


RULES = 9
_PLACES = 3 ** np.arange(RULES)


# Accuracies


@dataclass
class Model:
    prior: float
    good: np.ndarray  # of a rule that votes on a good text: the share of votes for it
    bad: np.ndarray  # and on a bad one: the share of votes against it

    def posterior(self, v: np.ndarray) -> np.ndarray:
        good = np.where(v == GOOD, np.log(self.good), 0) + np.where(v == BAD, np.log1p(-self.good), 0)
        bad = np.where(v == BAD, np.log(self.bad), 0) + np.where(v == GOOD, np.log1p(-self.bad), 0)
        return 1 / (1 + np.exp(bad.sum(-1) + np.log1p(-self.prior) - good.sum(-1) - np.log(self.prior)))


def estimate(v: np.ndarray, n: np.ndarray, rounds: int = 200, start: float = 0.9, caught: float = 0.4) -> Model:
    """Expectation-maximisation over vote patterns ``v`` that occur ``n`` times; abstaining says nothing.

    A rule looks for one fault, so it passes most good texts (``start`` at first, never under a half, so good and bad
    cannot change places) but also many bad ones, whose fault is another (``caught`` at first). Without any text the
    model is the start.
    """
    model = Model(start, np.full(v.shape[1], start), np.full(v.shape[1], caught))
    for _ in range(rounds if len(n) else 0):
        p = model.posterior(v)
        up, down = (n * p)[:, None], (n * (1 - p))[:, None]
        smooth = lambda hit, all_, first, low: np.clip((hit.sum(0) + first) / (all_.sum(0) + 1), low, 1 - 1e-4)
        new = Model(
            float(np.clip(up.sum() / n.sum(), 0.01, 0.99)),
            smooth(up * (v == GOOD), up * (v != ABSTAIN), start, 0.5),
            smooth(down * (v == BAD), down * (v != ABSTAIN), caught, 0.01),
        )
        moved = max(abs(new.prior - model.prior), np.abs(new.good - model.good).max(), np.abs(new.bad - model.bad).max())
        model = new
        if moved < 1e-9:
            break
    return model


# On Spark


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in numtext.slices(batch.column("text")):
                m = measures(data, offsets)
                pattern = (votes(m).astype(np.int64) * _PLACES).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(m[c]) for c in _COUNTS], pa.array(pattern)], names=["doc_id", *_COUNTS, "pattern"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(task, ", ".join(f"{c} long" for c in ["doc_id", *_COUNTS, "pattern"]))


def patterns(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // _PLACES % 3


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``posterior`` per row.

    Accuracies come from the vote patterns of all texts: a table of at most 3**9 rows. A null text has no words
    and fails the base; a text on which no rule votes has the prior. Ids may be null or repeat.
    """
    rows = materialise(_measured(docs), "measures")
    seen = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    model = estimate(patterns(seen.column("pattern").to_numpy().astype(np.int64)), seen.column("n").to_numpy().astype(float))
    by_code = docs.sparkSession.sparkContext.broadcast(model.posterior(patterns(np.arange(3**RULES))))

    @F.arrow_udf("double")
    def posterior(codes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in codes:
            yield pa.array(by_code.value[values.to_numpy(zero_copy_only=False).astype(np.int64)])

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = rows.withColumn("posterior", posterior("pattern")).withColumn("base_failed", failed)
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
