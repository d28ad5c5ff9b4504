"""Running cases: each side is a SQL text or a function of the database's tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import ledger, results
from concord.session import scratch_path

SIDES_SCHEMA = "case_id string, side string, status string, run string"
Form = str | Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Case:
    case_id: str
    db_id: str
    expected: Form
    actual: Form


#: What an error says when the cluster, not the case, is at fault.
_PASSING = re.compile(
    r"(?i)executor ?lost|lost executor|fetch ?failed|no space left|connection (reset|refused)|heartbeat|timed out|out ?of ?memory|block.*not found"
)


def _frame(spark: SparkSession, form: Form, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of one side. A SQL text sees the tables of its database as views, while it is planned.

    Afterwards the views are gone and the caller's own are back, so a case never reads tables of another.
    """
    if callable(form):
        return form(tables)
    held = {t.name.lower(): t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(held[name.lower()]) for name in tables if name.lower() in held}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(form)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _failure(e: Exception) -> str:
    return f"{'transient' if _PASSING.search(str(e)) else 'failed'}: {type(e).__name__}"


def run_cases(
    spark: SparkSession, cases: Sequence[Case], databases: Mapping[str, Mapping[str, DataFrame]],
    path: str | None = None, profile: str = "strict", batch: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Results of all cases as stored canonical rows, and their side records.

    Tables are the caller's, loaded once per database. Cases are written ``batch`` results to a
    job; a batch that fails is halved until the sides at fault stand alone, some two jobs for each halving. A side that
    cannot be planned, or that fails alone, is recorded as failed and leaves no rows. Where the cluster was at fault the case stays out of the result, and
    another call with the same ``path`` runs it again; sides already recorded there are not run again. Rows count
    only under the run that their side record names, so what an interrupted call left behind is not read.
    """
    path = path or scratch_path(spark, "case-rows")
    recorded = ledger.read_table(spark, f"{path}/sides", spark.createDataFrame([], SIDES_SCHEMA).schema)
    done = {(r.case_id, r.side) for r in recorded.select("case_id", "side").collect()}
    spark.createDataFrame([], results.ROWS_SCHEMA).write.mode("append").parquet(f"{path}/rows/run=none")
    passing: set[str] = set()
    planned: list[tuple[str, str, DataFrame]] = []

    def record(entries: Sequence[tuple[str, str, str]], run: str) -> None:
        kept = [(*x, run) for x in entries if not x[2].startswith("transient")]
        passing.update(x[0] for x in entries if x[2].startswith("transient"))
        if kept:
            spark.createDataFrame(kept, SIDES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/sides")

    def store(sides: Sequence[tuple[str, str, DataFrame]]) -> None:
        run = f"r{uuid.uuid4().hex}"  # never read as a number
        reduce(DataFrame.unionByName, [rows for _, _, rows in sides]).write.parquet(f"{path}/rows/run={run}")
        record([(c, s, "ok") for c, s, _ in sides], run)

    def settle(group: Sequence[tuple[str, str, DataFrame]], fails: bool = False) -> bool:
        """Store what can be stored of a group, by halves; ``fails`` if it is known to hold a side that fails."""
        if not fails or len(group) == 1:
            try:
                store(group)
                return True
            except Exception as e:
                if len(group) == 1:
                    record([(*group[0][:2], _failure(e))], "none")
                    return False
        half = len(group) // 2
        first = settle(group[:half])
        settle(group[half:], fails=first)  # if the first half is sound, the fault lies in the other
        return False

    def flush() -> None:
        if planned:
            settle(planned)
        planned.clear()

    for case in cases:
        for side, form in zip(results.SIDES, (case.expected, case.actual)):
            if (case.case_id, side) in done:
                continue
            try:
                df = _frame(spark, form, databases[case.db_id])
                rows = results.rows_from_frame(df, F.lit(case.case_id), side, df.columns, profile)
                planned.append((case.case_id, side, rows))
            except Exception as e:
                record([(case.case_id, side, _failure(e))], "none")
        if len(planned) >= batch:
            flush()
    flush()
    sides = ledger.read_table(spark, f"{path}/sides", recorded.schema)
    if passing:
        sides = sides.join(spark.createDataFrame([(c,) for c in sorted(passing)], "case_id string"), "case_id", "left_anti")
    rows = spark.read.schema(f"{results.ROWS_SCHEMA}, run string").parquet(f"{path}/rows")
    rows = rows.join(sides.select("case_id", "side", "run"), ["case_id", "side", "run"], "left_semi").drop("run")
    return rows, results.complete_sides(rows, sides.select("case_id", "side", "status"))
