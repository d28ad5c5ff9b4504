"""Question batches through caller-supplied models: direct, and in three phases."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import records, text
from concord.operators import cards as C
from concord.operators.stage import stage_to_table

PHASES = ("probe", "oracle", "final")


def _final(stage: DataFrame, kind: str) -> DataFrame:
    answer = text.extract_sql(F.col("response")) if kind == "sql" else text.extract_code(F.col("response"))
    if kind == "sql":
        answer = records.ensure_select_prefix(answer)
    return stage.select("question_id", answer.alias("final"), "reasoning", "status", "error")


def direct(
    corpus: DataFrame, cards: DataFrame, fn: Callable, template: Sequence[C.Part], path: str,
    kind: str = "sql", partitions: int | None = None,
) -> DataFrame:
    """One call per question: ``question_id, final, reasoning, status, error``."""
    prompts = C.build_prompts(corpus, cards, template, ("question_id",))
    return _final(stage_to_table(prompts, fn, "final", path, partitions), kind)


def three_phase(
    corpus: DataFrame, cards: DataFrame, fn_target: Callable, fn_oracle: Callable,
    templates: Mapping[str, Sequence[C.Part]], path: str, kind: str = "sql", partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Probe for ambiguity, answer from gold, then answer with the extended knowledge.

    Each phase runs over the whole corpus and is stored before the next, so no call is repeated
    and an interrupted run goes on where it stopped. The oracle template may use ``inquiry`` and
    the gold columns, the final one ``knowledge`` with the answer added as a note. A question whose
    phase failed for good has no response there and goes on with empty text; after a failure that may pass
    it waits, with a final row of status ``transient``, until another run gets the phase done. Returns the
    final answers and the phase table ``question_id, phase, prompt, response, ...``.
    """
    def phase(name: str, frame: DataFrame, fn: Callable) -> DataFrame:
        prompts = C.build_prompts(frame, cards, templates[name], ("question_id",))
        return stage_to_table(prompts, fn, name, path, partitions)

    def over(stage: DataFrame) -> DataFrame:
        return stage.filter(F.coalesce(F.col("status"), F.lit("ok")) != "transient")

    probe = phase("probe", corpus, fn_target)
    asked = corpus.join(over(probe).select("question_id", F.col("response").alias("inquiry")), "question_id")
    oracle = phase("oracle", asked, fn_oracle)
    answer = text.extract_answer(F.col("response")).alias("answer")
    ready = over(oracle).join(over(probe).select("question_id"), "question_id", "left_semi")
    told = corpus.join(ready.select("question_id", answer), "question_id").withColumn(
        "knowledge", C.with_note(F.col("knowledge"), F.col("answer"))
    )
    final = phase("final", told, fn_target)
    waiting = corpus.select("question_id").join(told.select("question_id"), "question_id", "left_anti").select(
        "question_id", F.lit(None).cast("string").alias("final"), F.lit(None).cast("string").alias("reasoning"),
        F.lit("transient").alias("status"), F.lit("an earlier phase is not done").alias("error"),
    )
    answers = _final(final.join(told.select("question_id"), "question_id", "left_semi"), kind).unionByName(waiting)
    return answers, probe.unionByName(oracle).unionByName(final)
