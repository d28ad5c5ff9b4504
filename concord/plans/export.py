"""Exporting the tables of a database."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from concord.operators.cards import SYSTEM_TABLES
from concord.sources.sinks import export_table


def export_database(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str, keys: Mapping[str, Sequence[str]] | None = None,
    exclude: Sequence[str] = SYSTEM_TABLES,
) -> DataFrame:
    """Write each table to ``<path>/<table>.csv``; a table that fails does not stop the others."""
    status = []
    for name, df in tables.items():
        if name in exclude:
            continue
        try:
            export_table(df, f"{path.rstrip('/')}/{name}.csv", (keys or {}).get(name, ()))
            status.append((name, "ok"))
        except Exception as e:
            status.append((name, f"failed: {type(e).__name__}"))
    return spark.createDataFrame(status, "table_name string, status string")
