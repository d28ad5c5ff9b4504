"""Registry and SQL fragments shared by the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.functions.canon import WHITESPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


WS = "'" + WHITESPACE + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_units(x: str, digits: int = 2) -> str:
    """Exact half-even rounding of a double to units, by the sign of the error in every row."""
    s = f"{10**digits}::DOUBLE"
    p = f"({x}*{s})"
    hi = f"({x}*134217729::DOUBLE-({x}*134217729::DOUBLE-{x}))"
    err = f"(({hi}*{s}-{p})+({x}-{hi})*{s})"
    k = f"round_even({p},0)"
    over, under = f"((({p}-{k})-0.5::DOUBLE)+{err})", f"((({p}-{k})+0.5::DOUBLE)+{err})"
    odd = f"(abs({k})%2=1)"
    return (
        f"(CASE WHEN abs({p})<9007199254740992 THEN CAST(CASE WHEN {over}>0 OR ({over}=0 AND {odd}) THEN {k}+1 "
        f"WHEN {under}<0 OR ({under}=0 AND {odd}) THEN {k}-1 ELSE {k} END AS BIGINT) END)"
    )


def sql_cents(x: str) -> str:
    """Units of a value that has at most two decimals."""
    return f"CAST(round_even({x}*100,0) AS BIGINT)"
