"""Column expressions over question and prediction records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MARKER = "\t-----\t"


def merge_knowledge(evidence: Column, verified: Column, mode: str = "plain") -> Column:
    """Evidence and verified knowledge as one text.

    ``plain`` concatenates them without a separator; ``labelled`` prefixes each non-empty part with
    its label and joins them with a bar. Absent parts count as empty.
    """
    e, v = F.coalesce(evidence.cast("string"), F.lit("")), F.coalesce(verified.cast("string"), F.lit(""))
    if mode == "plain":
        return F.concat(e, v)
    if mode == "labelled":
        return F.concat_ws(
            " | ",
            F.when(e != "", F.concat(F.lit("Evidence: "), e)),
            F.when(v != "", F.concat(F.lit("Verified Knowledge: "), v)),
        )
    raise ValueError("mode is 'plain' or 'labelled'")


def first_nonempty(columns: Sequence[Column]) -> Column:
    """The first column that is neither null nor empty; of a JSON list, its first item.

    Null where all are empty.
    """
    def value(c: Column) -> Column:
        text = c.cast("string")
        item = F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(text, "array<string>"))
        return F.nullif(F.when(F.size(item) > 0, F.get(item, F.lit(0))).otherwise(
            F.when(F.size(item) == 0, F.lit("")).otherwise(text)), F.lit(""))

    return F.coalesce(*[value(c) for c in columns])


def database_path(db_id: Column, root: str) -> Column:
    return F.concat(F.lit(root), db_id, F.lit("/"), db_id, F.lit(".sqlite"))


def database_of(path: Column) -> Column:
    """The database id in a database path: its last part, up to the extension."""
    return F.split_part(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(".sqlite"), F.lit(1))


def ensure_select_prefix(sql: Column, strict_compat: bool = False) -> Column:
    """Prepend SELECT to a non-empty text that does not start with it.

    A text that starts with WITH is a whole query and is left alone, unless ``strict_compat`` asks
    for the plain rule.
    """
    start = F.upper(sql)
    whole = start.startswith("SELECT")
    if not strict_compat:
        whole = whole | sql.rlike(r"(?i)^with\s")
    return F.when((sql != "") & ~whole, F.concat(F.lit("SELECT "), sql)).otherwise(sql)


def encode_prediction(sql: Column, db_id: Column, marker: str = DEFAULT_MARKER) -> Column:
    """SQL text and database id in one string, divided by the marker the receiving tool expects."""
    return F.concat(sql, F.lit(marker), db_id)


def decode_prediction(wire: Column, marker: str = DEFAULT_MARKER) -> Column:
    """``struct<sql, db_id>`` of an encoded prediction; without a marker the whole text is SQL."""
    has = wire.contains(marker)
    return F.struct(
        F.when(has, F.split_part(wire, F.lit(marker), F.lit(1))).otherwise(wire).alias("sql"),
        F.when(has, F.split_part(wire, F.lit(marker), F.lit(-1))).alias("db_id"),
    )
