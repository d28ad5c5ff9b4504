"""Accuracy by stratum, its report, and the full log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text
from concord.operators.ledger import latest_entry

# The difficulty levels, in report order.
LEVELS = ("simple", "moderate", "challenging")


def accuracy(
    verdicts: DataFrame, strata: DataFrame, col: str = "difficulty", levels: Sequence[str] = LEVELS,
    key: str = "case_id", order: str | Column | None = None,
) -> DataFrame:
    """``level, n, n_correct, accuracy`` for each level and their total.

    Verdicts without a stratum, or with a level not listed, do not count; the total covers the
    listed levels only. With ``order`` the last stratum of a repeated id wins; without it the ids
    must be unique.
    """
    strata = strata.select(key, F.col(col).alias("level"), *([F.col(order).alias("_o") if isinstance(order, str) else order.alias("_o")] if order is not None else []))
    if order is not None:
        strata = latest_entry(strata, key, "_o").drop("_o")
    spark = verdicts.sparkSession
    correct = F.count(F.when(F.col("res") == 1, 1))
    counted = (
        verdicts.select(key, "res")
        .join(strata.filter(F.col("level").isin(*levels)), key)
        .groupBy("level")
        .agg(F.count("*").alias("n"), correct.alias("n_correct"))
    )
    names = spark.createDataFrame([(i, name) for i, name in enumerate(levels)], "pos int, level string")
    filled = names.join(counted, "level", "left").na.fill(0, ["n", "n_correct"])
    return (
        filled.rollup("pos", "level")
        .agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
        .filter(F.col("gid").isin(0, 3))
        .select(
            F.coalesce("pos", F.lit(len(levels))).alias("pos"),
            F.coalesce("level", F.lit("total")).alias("level"),
            "n", "n_correct",
            F.when(F.col("n") > 0, F.col("n_correct") / F.col("n") * 100).otherwise(0.0).alias("accuracy"),
        )
    )


def accuracy_report(acc: DataFrame) -> DataFrame:
    """One text line per level: ``level: correct/n, accuracy``."""
    line = F.format_string("%-12s: %d/%d correct, accuracy = %.4f%%", "level", "n_correct", "n", "accuracy")
    return acc.orderBy("pos").select("pos", line.alias("line"))


def full_log(corpus: DataFrame, phases: DataFrame, preds: DataFrame, gold: str = "gold_sql") -> DataFrame:
    """One row per question with its gold answer, the exchange about it and the final answer.

    ``phases(question_id, phase, response)`` holds the phases ``probe`` and ``oracle``;
    ``preds(question_id, final)`` the final answers. Missing parts are empty texts.
    """
    response = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("response"))).alias(phase)
    exchange = phases.groupBy("question_id").agg(response("probe"), response("oracle"))
    empty = F.lit("")
    return (
        corpus.select("question_id", "question", F.col(gold).alias("gold"))
        .join(exchange, "question_id", "left")
        .join(preds.select("question_id", "final"), "question_id", "left")
        .select(
            "question_id", "question", F.coalesce("gold", empty).alias("gold"),
            F.coalesce("probe", empty).alias("inquiry"),
            F.coalesce(text.extract_answer(F.col("oracle")), empty).alias("answer"),
            text.extract_categories(F.col("oracle")).alias("categories"),
            F.coalesce("final", empty).alias("final"),
        )
    )


def totals(parts: DataFrame) -> DataFrame:
    """``level, n, n_correct`` from counts that were kept batch by batch."""
    return parts.groupBy("level").agg(F.sum("n").cast("bigint").alias("n"), F.sum("n_correct").cast("bigint").alias("n_correct"))
