"""Batch stages around a caller's function, with typed failures and resume."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import text
from concord.operators import ledger

STAGE_SCHEMA = (
    "question_id bigint, phase string, prompt string, response string, reasoning string, "
    "status string, error string"
)


_ANSWERED = pa.schema([("question_id", pa.int64()), ("prompt", pa.string()), ("response", pa.string()), ("reasoning", pa.string()),
                       ("error", pa.string()), ("error_type", pa.string()), ("run", pa.int64())])


def _call(fn: Callable, prompt: str, retries: int, pause: float) -> tuple[str | None, str | None, str | None, str | None]:
    """Response, reasoning, error and the classes of the error; a failed call is tried again after a growing pause."""
    for attempt in range(retries + 1):
        try:
            value = fn(prompt)
            answer, thought = value if isinstance(value, tuple) else (value, None)
            return answer, thought, None, None
        except Exception as e:  # a failed call is a row with a status, never an answer
            failure = None, None, str(e), " ".join(c.__name__ for c in type(e).__mro__)
        if attempt < retries:
            time.sleep(pause * 2**attempt)
    return failure


class _Journal:
    """Answers that a task has got, in files of the shared folder: a file for each chunk, seen only once it is whole.

    Another attempt of the task finds them there and does not ask again.
    """

    def __init__(self, path: str, part: int) -> None:
        uri = f"{path}/part={part}"
        local = re.match(r"(?:file:)?/+(.*)", uri)
        self.files, self.folder = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.folder, recursive=True)
        self.known: dict[tuple, tuple] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".parquet"):
                for r in pq.read_table(info.path, filesystem=self.files, schema=_ANSWERED).to_pylist():
                    self.known[r["question_id"], r["prompt"]] = r["response"], r["reasoning"], r["error"], r["error_type"]

    def add(self, rows: list[tuple], run: int) -> None:
        name = f"{self.folder}/{uuid.uuid4().hex}"
        columns = list(zip(*[(*r, run) for r in rows]))
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWERED)], schema=_ANSWERED), f"{name}.tmp", filesystem=self.files)
        self.files.move(f"{name}.tmp", f"{name}.parquet")


def _answers(
    fn: Callable, batches: Iterator[pd.DataFrame], in_col: str, concurrent: int, retries: int, pause: float, chunk: int, journal: tuple[str, int] | None,
) -> Iterator[pd.DataFrame]:
    held = _Journal(journal[0], TaskContext.get().partitionId()) if journal else None
    with ThreadPoolExecutor(concurrent) as pool:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                out = batch.iloc[at : at + chunk].copy()
                prompts = out[in_col].tolist()
                ids = [None if pd.isna(q) else int(q) for q in out["question_id"]] if held else prompts
                keys = list(zip(ids, prompts))
                got = [held.known.get(k) if held else None for k in keys]
                todo = [i for i, x in enumerate(got) if x is None]
                for i, answer in zip(todo, pool.map(lambda i: _call(fn, prompts[i], retries, pause), todo)):
                    got[i] = answer
                if held and todo:
                    held.add([(*keys[i], *got[i]) for i in todo], journal[1])
                for name, column in zip(("response", "reasoning", "error", "error_type"), zip(*got)):
                    out[name] = pd.Series(column, index=out.index, dtype=object)
                yield out


def run_stage(
    df: DataFrame, fn: Callable, in_col: str = "prompt", partitions: int | None = None, concurrent: int = 1, retries: int = 0,
    pause: float = 1.0, chunk: int = 16, journal: tuple[str, int] | None = None,
) -> DataFrame:
    """Call ``fn`` once per row and add ``response, reasoning, status, error``.

    ``fn`` takes the prompt and returns the response, or response and reasoning. Rows are spread over
    ``partitions`` tasks of ``concurrent`` calls each, which bounds the calls in flight. A call that raises is tried
    ``retries`` times more, after pauses that double; then its exception gives ``status`` transient or permanent and no
    response. With a ``journal`` (folder and run) each ``chunk`` of answers is kept there as soon as it is complete, by
    ``question_id`` and prompt, so an attempt after a lost one asks the rest alone. The result is lazy: write it before
    using it twice, or the function is called again.
    """
    spread = df.repartition(partitions) if partitions else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    called = spread.mapInPandas(
        lambda batches: _answers(fn, batches, in_col, concurrent, retries, pause, chunk, journal),
        f"{schema}, response string, reasoning string, error string, error_type string",
    )
    return called.withColumn("status", _status()).select(*df.columns, "response", "reasoning", "status", "error")


def _status():
    return F.coalesce(text.classify_failure(F.col("error"), F.col("error_type")), F.lit("ok"))


def _recover(spark, path: str, phase: str, held: DataFrame) -> None:
    """Move answers that a run journalled but never got into the table there."""
    folder = _journal_folder(path, phase)
    if not ledger.path_exists(spark, folder):
        return
    kept = spark.read.schema("question_id bigint, prompt string, response string, reasoning string, error string, error_type string, run bigint")
    kept = kept.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder).dropDuplicates(["question_id", "prompt", "run"])
    lost = kept.join(held.select("question_id", "prompt", "run"), ["question_id", "prompt", "run"], "left_anti").withColumn("status", _status())
    _append(lost, path, phase)


def _journal_folder(path: str, phase: str) -> str:
    return f"{path.rstrip('/')}-journal/phase={phase}"


def _append(answers: DataFrame, path: str, phase: str) -> None:
    columns = ["question_id", "prompt", "response", "reasoning", "status", "error", F.col("run").cast("bigint").alias("run"), F.lit(phase).alias("phase")]
    answers.select(*columns).write.mode("append").partitionBy("phase").parquet(path)


def stage_to_table(
    prompts: DataFrame, fn: Callable, phase: str, path: str, partitions: int | None = None, concurrent: int = 1, retries: int = 0, chunk: int = 16,
) -> DataFrame:
    """Run one phase for the questions its table does not hold yet, append, and read it back.

    ``prompts(question_id, prompt)``. The table is partitioned by phase. A question is done when it has an answer
    or a lasting failure to the very same prompt: it is asked again after a failure that may pass, or when
    its prompt has changed. The newest row of a question counts. Answers are journalled beside the table as they come, so after a
    job that was lost another call goes on with what is left, beyond one ``chunk`` a task.
    """
    spark = prompts.sparkSession
    def held() -> DataFrame:
        return ledger.read_table(spark, path, spark.createDataFrame([], STAGE_SCHEMA + ", run bigint").schema).filter(
            F.col("phase") == phase
        )
    _recover(spark, path, phase, held())
    before = held()
    run = (before.agg(F.max("run")).first()[0] or 0) + 1
    asked = F.xxhash64("prompt").alias("asked")
    over = before.filter(F.coalesce(F.col("status"), F.lit("ok")) != "transient").select("question_id", asked).distinct()
    todo = prompts.withColumn("asked", asked).join(over, ["question_id", "asked"], "left_anti")
    journal = f"{_journal_folder(path, phase)}/run={run}", run
    done = run_stage(todo.select(F.col("question_id").cast("bigint").alias("question_id"), "prompt"), fn, "prompt", partitions, concurrent, retries, chunk=chunk, journal=journal)
    _append(done.withColumn("run", F.lit(run)), path, phase)
    return ledger.latest_entry(held(), "question_id", "run").drop("run").select(
        "question_id", "phase", "prompt", "response", "reasoning", "status", "error"
    )
