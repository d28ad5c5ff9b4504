"""Result tables of all cases in one frame.

Three shapes, each derivable from a DataFrame or from JSON text:

* ``cells(case_id, side, row_no, col_no, raw, kind)``: one row per cell, the exchange form.
* ``rows(case_id, side, cells)``: one row per result row, ``cells`` an array of canonical cells.
* ``coded(case_id, side, codes)``: one row per result row, ``codes`` an array of comparison keys.

``sides(case_id, side, n_rows, n_cols, status)`` records that a side exists, also when it is empty
or failed. ``side`` is ``expected`` or ``actual``. Rows without a case are kept in all shapes, under a null case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import canon

SIDES = ("expected", "actual")
CELLS_SCHEMA = "case_id string, side string, row_no bigint, col_no int, raw string, kind string"
ROWS_SCHEMA = f"case_id string, side string, cells array<{canon.CELL_TYPE}>"
SIDES_SCHEMA = "case_id string, side string, n_rows bigint, n_cols int, status string"


def _case_column(case: str | Column) -> Column:
    return (F.col(case) if isinstance(case, str) else case).cast("string")


def _typed(df: DataFrame, values: Sequence[str] | None, case: str | Column) -> list[T.StructField]:
    names = values or [f.name for f in df.schema if f.name != case]
    return [df.schema[name] for name in names]


def to_cells(
    df: DataFrame, case: str | Column, side: str, values: Sequence[str] | None = None,
    row_no: str | Column | None = None,
) -> DataFrame:
    """Long cell table of a result frame. ``row_no`` only names a row; it carries no order."""
    fields = _typed(df, values, case)
    cells = ", ".join(
        f"struct({canon.to_text(f)} AS raw, nvl2({canon.quote(f.name)}, '{canon.kind_of(f.dataType)}', 'null') AS kind)"
        for f in fields
    )
    number = F.monotonically_increasing_id() if row_no is None else row_no
    number = F.col(number) if isinstance(number, str) else number
    return df.select(
        _case_column(case).alias("case_id"),
        F.lit(side).alias("side"),
        number.cast("bigint").alias("row_no"),
        F.posexplode(F.expr(f"array({cells})")).alias("col_no", "cell"),
    ).select("case_id", "side", "row_no", "col_no", "cell.raw", "cell.kind")


def canonical_cells(cells: DataFrame, profile: str = "strict") -> DataFrame:
    """Any frame with ``raw`` and ``kind``, these two replaced by the canonical ``num`` and ``txt``.

    Three projections, each of which uses the one before more than once: so none is merged into the
    next, every step is worked out once per cell, and the generated methods stay small.
    """
    rest = [c for c in cells.columns if c not in ("raw", "kind")]
    return (
        cells.select(*rest, F.expr(f"CASE WHEN kind = 'string' THEN {canon.strip('raw')} ELSE trim(raw) END").alias("t"), "kind")
        .select(*rest, "t", "kind", F.expr(canon.cell_number("t", "kind", profile)).alias("num"))
        .select(*rest, "num", F.expr(canon.cell_text("t", "kind", "num", profile)).alias("txt"))
    )


def rows_from_cells(cells: DataFrame, profile: str = "strict") -> DataFrame:
    """Canonical rows from the long cell table: one shuffle on the row, never on the case."""
    return (
        canonical_cells(cells, profile)
        .groupBy("case_id", "side", "row_no")
        .agg(F.sort_array(F.collect_list(F.struct("col_no", "num", "txt"))).alias("c"))
        .select("case_id", "side", F.transform("c", lambda x: F.struct(x["num"], x["txt"])).alias("cells"))
    )


def _unfused(values: Sequence[str]) -> Column:
    """An array of expressions, evaluated outside Spark's fused loop.

    The fused loop puts all expressions of a row into one method, and the JVM does not compile a
    method as large as those of a table with many columns. A projection that holds a lambda is left
    out of the loop, and its generated code is cut into small methods.
    """
    return F.expr(f"CASE WHEN exists(array(case_id), c -> length(c) < 0) THEN NULL ELSE array({', '.join(values)}) END")


def _stage(df, case, side, fields, profile) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``case_id, side`` and one column per field: ``v*`` plain, ``t*`` stripped text.

    Also the column names by field, and for each text column the expression of its number. Each
    projection uses the one before more than once, so Spark never merges them and repeats work.
    """
    names = [f"v{i}" if canon.is_plain(f.dataType) else f"t{i}" for i, f in enumerate(fields)]
    columns = [
        F.expr(canon.strip(canon.to_text(f)) if n[0] == "t" else f"CAST({canon.quote(f.name)} AS DOUBLE)"
               if canon.is_fractional(f.dataType) else canon.quote(f.name)).alias(n)
        for f, n in zip(fields, names)
    ]
    frame = df.select(_case_column(case).alias("case_id"), F.lit(side).alias("side"), *columns)
    texts = [n for n in names if n[0] == "t"]
    if texts:
        frame = frame.select("*", _unfused([canon.text_number(t, profile) for t in texts]).alias("xs"))
    return frame, names, {t: f"get(xs, {i})" for i, t in enumerate(texts)}


def rows_from_frame(
    df: DataFrame, case: str | Column, side: str, values: Sequence[str] | None = None,
    profile: str = "strict",
) -> DataFrame:
    """Canonical rows straight from a frame: no shuffle, one expression per column type."""
    fields = _typed(df, values, case)
    frame, names, numbers = _stage(df, case, side, fields, profile)
    cells = [
        canon.text_cell(n, numbers[n], profile) if n in numbers else canon.plain_cell(n, f.dataType)
        for n, f in zip(names, fields)
    ]
    return frame.select("case_id", "side", _unfused(cells).cast(f"array<{canon.CELL_TYPE}>").alias("cells"))


def coded_from_frame(
    df: DataFrame, case: str | Column, side: str, values: Sequence[str] | None = None,
    profile: str = "strict", digits: int = 2,
) -> DataFrame:
    """Coded rows straight from a frame: no shuffle, one expression per column type."""
    fields = _typed(df, values, case)
    frame, names, numbers = _stage(df, case, side, fields, profile)
    codes = [
        canon.text_code(n, numbers[n], canon.rounded_units(numbers[n], digits), profile)
        if n in numbers else canon.plain_code(n, f.dataType, digits)
        for n, f in zip(names, fields)
    ]
    return frame.select("case_id", "side", _unfused([f"coalesce({c}, 'z')" for c in codes]).alias("codes"))


def coded(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Coded rows from canonical rows."""
    return rows.select(
        "case_id", "side", F.expr(f"transform(cells, c -> {canon.cell_code('c', digits)})").alias("codes")
    )


# --- JSON outputs --------------------------------------------------------------------------


def _variant(text: str) -> str:
    """JSON text as a variant; bare NaN and Infinity, which JSON lacks, count as null."""
    bare = f"regexp_replace({text}, r'(?<=[\\[,:\\s])-?(?:NaN|Infinity)(?=[\\],}}\\s])', 'null')"
    return f"coalesce(try_parse_json({text}), try_parse_json({bare}))"


def _is(v: str, shape: str) -> str:
    return f"startswith(schema_of_variant({v}), '{shape}')"


def _get(v: str, dtype: str) -> str:
    return f"try_variant_get({v}, '$', '{dtype}')"


def _items(v: str) -> str:
    return _get(v, "array<variant>")


_MAP = "map<string,variant>"

# An object as [key, value] pairs in key order.
_ENTRIES = f"transform(array_sort(map_keys({_get('v', _MAP)})), k -> array(CAST(k AS VARIANT), element_at({_get('v', _MAP)}, k)))"

# One item of a list as a row: a list gives its items (flattened two levels), an object its values.
_ITEM_ROW = (
    f"CASE WHEN {_is('x', 'ARRAY')} THEN flatten(transform({_items('x')}, y -> CASE WHEN {_is('y', 'ARRAY')} "
    f"THEN flatten(transform({_items('y')}, w -> CASE WHEN {_is('w', 'ARRAY')} THEN {_items('w')} ELSE array(w) END)) "
    f"ELSE array(y) END)) WHEN {_is('x', 'OBJECT')} THEN map_values({_get('x', _MAP)}) ELSE array(x) END"
)
_TABLE = (
    f"CASE WHEN {_is('v', 'ARRAY')} THEN transform({_items('v')}, x -> {_ITEM_ROW}) "
    f"WHEN {_is('v', 'OBJECT')} THEN {_ENTRIES} ELSE array(array(v)) END"
)
_KIND = (
    "CASE schema_of_variant(x) WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VOID' THEN 'null' "
    f"ELSE CASE WHEN {_is('x', 'OBJECT')} OR {_is('x', 'ARRAY')} THEN 'string' ELSE 'number' END END"
)


def rows_from_json(
    df: DataFrame, case: str | Column, side: str, output: str = "output", profile: str = "strict"
) -> tuple[DataFrame, DataFrame]:
    """Canonical rows and side records from results stored as JSON text of any shape.

    A list of lists gives rows, a flat list an n×1 column, an object its sorted pairs, an object
    inside a list the row of its values, a scalar a 1×1 table. A text that holds a stringified
    collection is parsed first. A null output gives a side with status ``missing``. Both frames
    repeat the parsing, so store the rows when more than one query reads them.
    """
    read = df.select(_case_column(case).alias("case_id"), F.col(output).alias("output")).select(
        "case_id", "output", F.expr(_variant("output")).alias("v")
    )
    as_text = f"coalesce(CASE WHEN schema_of_variant(v) = 'STRING' THEN {_get('v', 'string')} END, CASE WHEN v IS NULL THEN output END)"
    parsed = read.select("case_id", "v", "output", F.expr(as_text).alias("s")).select(
        "case_id", F.expr(f"coalesce({canon.parse_collection('s')}, v, CAST(output AS VARIANT))").alias("v")
    )
    shaped = parsed.select("case_id", F.expr("v IS NULL OR schema_of_variant(v) = 'VOID'").alias("missing"), "v").select(
        "case_id", "missing", F.expr(f"CASE WHEN NOT missing THEN {_TABLE} END").alias("t")
    )
    raw = f"transform(r, x -> struct({canon.strip(_get('x', 'string'))} AS t, {_KIND} AS kind))"
    number = f"transform(r, c -> struct(c.t AS t, c.kind AS kind, {canon.cell_number('c.t', 'c.kind', profile)} AS num))"
    cell = f"transform(r, c -> struct(c.num AS num, {canon.cell_text('c.t', 'c.kind', 'c.num', profile)} AS txt))"
    rows = (
        shaped.select("case_id", F.explode("t").alias("r"))
        .select("case_id", F.expr(raw).alias("r"))
        .select("case_id", F.expr(number).alias("r"))
        .select("case_id", F.lit(side).alias("side"), F.expr(cell).cast(f"array<{canon.CELL_TYPE}>").alias("cells"))
    )
    sides = shaped.select(
        "case_id",
        F.lit(side).alias("side"),
        F.expr("CAST(coalesce(size(t), 0) AS BIGINT)").alias("n_rows"),
        F.expr("coalesce(array_max(transform(t, r -> size(r))), 0)").alias("n_cols"),
        F.expr("CASE WHEN missing THEN 'missing' ELSE 'ok' END").alias("status"),
    )
    return rows, sides


# --- sides ---------------------------------------------------------------------------------


def sides_of(rows: DataFrame, column: str = "cells") -> DataFrame:
    """Side records of the non-empty sides, from rows or coded rows."""
    return rows.groupBy("case_id", "side").agg(
        F.count("*").alias("n_rows"), F.max(F.size(column)).cast("int").alias("n_cols"), F.lit("ok").alias("status")
    )


def complete_sides(rows: DataFrame, declared: DataFrame, column: str = "cells") -> DataFrame:
    """Declared sides (``case_id, side, status``) with the sizes found in the rows."""
    found = sides_of(rows, column).drop("status")
    return declared.join(found, ["case_id", "side"], "left").select(
        "case_id", "side",
        F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"),
        F.coalesce("n_cols", F.lit(0)).alias("n_cols"),
        "status",
    )


def shape_class(sides: DataFrame, single_nulls: DataFrame | None = None) -> DataFrame:
    """Shape of each side: empty, scalar, row_vector, column_vector or table.

    With ``single_nulls`` (``case_id, side`` of 1×1 null sides) those count as empty too, which is
    the lenient reading.
    """
    shape = (
        F.when(F.col("n_rows") == 0, "empty")
        .when((F.col("n_rows") == 1) & (F.col("n_cols") == 1), "scalar")
        .when(F.col("n_rows") == 1, "row_vector")
        .when(F.col("n_cols") == 1, "column_vector")
        .otherwise("table")
    )
    if single_nulls is None:
        return sides.withColumn("shape", shape)
    marked = single_nulls.select("case_id", "side", F.lit(True).alias("null_only")).distinct()
    return (
        sides.join(marked, ["case_id", "side"], "left")
        .withColumn("shape", F.when(F.col("null_only") & (shape == "scalar"), "empty").otherwise(shape))
        .drop("null_only")
    )


def single_null_sides(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """``case_id, side`` of the 1×1 sides whose only cell is null."""
    one = sides.filter((F.col("n_rows") == 1) & (F.col("n_cols") == 1)).select("case_id", "side")
    cell = F.col("cells")[0]
    return rows.join(one, ["case_id", "side"], "left_semi").filter(
        cell["num"].isNull() & cell["txt"].isNull()
    ).select("case_id", "side")
