"""End-to-end evaluation: predictions and results in, verdicts and accuracy out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import ledger, metrics, parity, results
from concord.operators.cases import Case, run_cases
from concord.session import materialise
from concord.sources import sinks


def judge_outputs(
    expected: DataFrame, actual: DataFrame, key: str = "case_id", output: str = "output", profile: str = "strict"
) -> DataFrame:
    """Verdicts for results stored as JSON text on both sides, one record per case and side."""
    e_rows, e_sides = results.rows_from_json(expected, key, "expected", output, profile)
    a_rows, a_sides = results.rows_from_json(actual, key, "actual", output, profile)
    rows = materialise(e_rows.union(a_rows), "judged-rows")
    sides = materialise(e_sides.union(a_sides), "judged-sides")
    return parity.verdicts(rows, sides, profile)


def evaluate(
    preds: DataFrame, corpus: DataFrame, ledger_path: str, strata: DataFrame | None = None,
    profile: str = "strict", levels: Sequence[str] = metrics.LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Judge predictions against a corpus, append to the ledger, and report accuracy.

    ``preds(question_id, pos, output)`` holds produced results as JSON; the first prediction of an
    id counts, as does the first corpus record. A prediction without an expected output gets
    ``res`` 0. Questions already in the ledger are not judged again.
    """
    spark = preds.sparkSession
    empty = spark.createDataFrame([], ledger.VERDICT_SCHEMA)
    held = ledger.read_table(spark, ledger_path, empty.schema)
    first = ledger.keep_first(preds, "question_id", "pos").withColumn("case_id", F.col("question_id").cast("string"))
    todo = first.join(held.select("case_id"), "case_id", "left_anti")
    gold = ledger.keep_first(corpus.select("question_id", "pos", "output"), "question_id", "pos")
    gold = gold.select(F.col("question_id").cast("string").alias("case_id"), F.col("output"))
    wanted = todo.select("case_id").join(gold, "case_id", "left")
    judged = judge_outputs(wanted, todo.select("case_id", "output"), profile=profile)
    new = judged.select(
        "case_id", "res", "level", "diff_rows", "error",
        F.lit(None).cast("string").alias("db_id"), F.lit(None).cast("string").alias("judge_text"),
    )
    ledger.append_new(new, ledger_path, "case_id", "level")
    verdicts = spark.read.schema(empty.schema).parquet(ledger_path)
    if strata is None:
        strata = corpus.select(F.col("question_id").cast("string").alias("case_id"), "difficulty", "pos")
        return verdicts, metrics.accuracy(verdicts, strata, levels=levels, order="pos")
    return verdicts, metrics.accuracy(verdicts, strata, levels=levels)


def evaluate_cases(
    spark: SparkSession, cases: Sequence[Case], databases: Mapping[str, Mapping[str, DataFrame]], strata: DataFrame, path: str,
    profile: str = "strict", levels: Sequence[str] = metrics.LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Run cases, judge them, append new verdicts to the ledger under ``path``, and report accuracy.

    ``strata(case_id, difficulty)`` has one row a case. The verdicts carry their database; cases that failed go to the
    event log too, with the message. Where the cluster was at fault a case gets no verdict until another call with
    the same ``path`` runs it; a call that finds nothing new to run adds nothing. Returns the ledger and the accuracy.
    """
    rows, sides = run_cases(spark, cases, databases, f"{path}/cases", profile)
    empty = spark.createDataFrame([], ledger.VERDICT_SCHEMA)
    judged = parity.verdicts(rows, sides, profile)
    named = spark.createDataFrame([(c.case_id, c.db_id) for c in cases], "case_id string, db_id string").distinct()
    found = judged.join(named, "case_id", "left").withColumn("judge_text", F.lit(None).cast("string")).select(*empty.columns)
    held = ledger.read_table(spark, f"{path}/verdicts", empty.schema)
    new = materialise(ledger.new_rows(found, held, "case_id", "level"), "new-verdicts")
    failed = new.filter("error IS NOT NULL").select(F.lit("case failed").alias("type"), "case_id", F.col("error").alias("message"))
    sinks.event_log(failed, f"{path}/events")
    new.write.mode("append").parquet(f"{path}/verdicts")
    verdicts = ledger.read_table(spark, f"{path}/verdicts", empty.schema)
    return verdicts, metrics.accuracy(verdicts, strata, levels=levels)
