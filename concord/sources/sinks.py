"""Writing tables, predictions, phase logs and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import records


def float_text(c: Column, places: int = 10) -> Column:
    return F.format_string(f"%.{places}f", c)


def export_frame(df: DataFrame, float_dp: int = 10) -> DataFrame:
    """The frame as it is exported: floats as text with fixed decimal places."""
    return df.select(*[
        F.when(F.col(f.name).isNotNull(), float_text(F.col(f.name).cast("double"), float_dp)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
        for f in df.schema
    ])


def export_table(df: DataFrame, path: str, key_cols: Sequence[str] = (), float_dp: int = 10) -> None:
    """Write a table as CSV with a header, all values quoted, in key order.

    The order is global over the part files, by a range partitioning on the key; sorting happens
    on the typed key before floats become text. An empty table still writes its header.
    """
    ordered = df.orderBy(*key_cols) if key_cols else df
    (
        export_frame(ordered, float_dp).write.mode("overwrite")
        .option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    )


def write_predictions(df: DataFrame, path: str, kind: str, marker: str = records.DEFAULT_MARKER) -> None:
    """Predictions as JSON records keyed by question: ``kind`` is ``sql`` or ``code``.

    SQL predictions also carry the encoded form ``wire``.
    """
    if kind == "sql":
        wire = records.encode_prediction(F.col("sql"), F.col("db_id"), marker)
        df = df.select("question_id", "db_id", "sql", wire.alias("wire"))
    elif kind == "code":
        names = ("question_id", "db_id", "question", "code", "thinking", "error")
        df = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
    else:
        raise ValueError("kind is 'sql' or 'code'")
    df.write.mode("overwrite").json(path)


def write_phase_log(df: DataFrame, path: str) -> None:
    """Prompts and responses of all phases in one table, partitioned by phase."""
    df.select("question_id", "prompt", "response", "phase").write.mode("append").partitionBy("phase").parquet(path)


def event_log(events: DataFrame, path: str) -> None:
    """Append typed messages ``ts, type, case_id, message``."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.current_timestamp())
    events.select("ts", "type", "case_id", "message").write.mode("append").parquet(path)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))
