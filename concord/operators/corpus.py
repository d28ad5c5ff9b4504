"""Question records: flattening, ids, positions, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import records
from concord.session import materialise

GOLD_SQL_NAMES = ("sql", "query", "SQL")


def normalise_corpus(
    corpus: DataFrame, db_root: str = "", knowledge: str = "plain", gold: Sequence[str] = ("gold_sql",),
    code: str = "gold_code",
) -> DataFrame:
    """One flat record per question, keyed by its id."""
    have = set(corpus.columns)
    optional = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    return corpus.select(
        "question_id",
        "question",
        "db_id",
        records.database_path(F.col("db_id"), db_root).alias("db_path"),
        records.merge_knowledge(optional("evidence"), optional("verified_knowledge"), knowledge).alias("knowledge"),
        records.first_nonempty([optional(g) for g in gold]).alias("gold_sql"),
        records.first_nonempty([optional(code)]).alias("gold_code"),
        optional("difficulty").alias("difficulty"),
        optional("output").alias("output"),
    )


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Number the rows from 0 in the given (unique) order without gathering them in one task.

    The sorted rows are written once; each sorted piece then needs only the row counts of the
    pieces before it, one number per piece.
    """
    marked = materialise(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    piece = F.shiftright("_mid", 33)
    # One row per sorted piece, so the window below sees as many rows as there are partitions.
    counts = marked.groupBy(piece.alias("_piece")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return (
        marked.withColumn("_piece", piece)
        .join(F.broadcast(offsets), "_piece")
        .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_mid", "_piece", "_before")
    )


def assign_case_id(df: DataFrame, order: Sequence[str], name: str = "case_id") -> DataFrame:
    """``question_id``, else ``idx``, else the position in the given order."""
    have = set(df.columns)
    ids = [F.col(c) for c in ("question_id", "idx") if c in have]
    return with_position(df, order).withColumn(name, F.coalesce(*ids, F.col("pos"))).drop("pos")


def take_first(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the given order; all rows where ``n`` is 0 or absent."""
    return df.orderBy(*order).limit(n) if n else df
