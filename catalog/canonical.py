"""Canonical cells, shapes and parsed collections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, sql_strip, sql_units, table
from concord.functions import canon
from concord.operators import results

# A messy text per event, the same expression in both engines.
_MESSY = """CASE event_id % 14
    WHEN 0 THEN '007' WHEN 1 THEN concat('  ', event_type, ' ') WHEN 2 THEN CAST(value AS {text})
    WHEN 3 THEN CAST(ts AS {text}) WHEN 4 THEN 'Yes' WHEN 5 THEN 'NaN' WHEN 6 THEN '22.7%' WHEN 7 THEN '-5'
    WHEN 8 THEN '7:00' WHEN 9 THEN concat('3/', CAST(event_id % 31 + 1 AS {text}), '/2024') WHEN 10 THEN '3.14159'
    WHEN 11 THEN concat('90071992547409', CAST(10 + event_id % 90 AS {text})) WHEN 12 THEN concat('2024/', CAST(event_id % 15 AS {text}), '/07')
    ELSE concat(event_type, '-', props) END"""


def _canon_sql(profile: str) -> str:
    number = "regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"
    long_text = (
        "CASE WHEN regexp_matches(t, '^[+-]?[0-9]{16,38}$') AND TRY_CAST(t AS DECIMAL(38,0)) <> "
        "TRY_CAST(TRY_CAST(t AS DOUBLE) AS DECIMAL(38,0)) THEN CAST(TRY_CAST(t AS DECIMAL(38,0)) AS VARCHAR) END"
    )
    iso = "regexp_matches(t, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$')"
    slash = "regexp_matches(t, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')"
    swap = lambda order: f"TRY_CAST(regexp_replace(t, '^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})$', '{order}') AS DATE)"
    day = (
        f"CASE WHEN {iso} THEN TRY_CAST(replace(regexp_extract(t, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}'), '/', '-') AS DATE) "
        f"WHEN {slash} THEN coalesce({swap(chr(92) + '3-' + chr(92) + '1-' + chr(92) + '2')}, {swap(chr(92) + '3-' + chr(92) + '2-' + chr(92) + '1')}) END"
    )
    words_num = words_txt = ""
    if profile == "lenient":
        words_num = "WHEN lower(t) IN ('true','yes','y') THEN 1.0 WHEN lower(t) IN ('false','no','n') THEN 0.0"
        words_txt = (
            "WHEN lower(t) IN ('nan','none','null','nat','true','yes','y','false','no','n') THEN NULL "
            "WHEN regexp_matches(t, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$') THEN "
            "CASE WHEN length(t) <= 5 THEN lpad(t, 5, '0') || ':00' ELSE lpad(t, 8, '0') END"
        )
    return f"""
        WITH messy AS (SELECT event_id, {sql_strip('(' + _MESSY.format(text='VARCHAR') + ')')} AS t FROM events),
        cells AS (SELECT event_id,
            CASE WHEN {number} AND ({long_text}) IS NULL THEN CAST(t AS DOUBLE) {words_num} END AS num,
            CASE WHEN {number} THEN {long_text} {words_txt}
                 WHEN contains(t, '-') OR contains(t, '/') THEN coalesce(CAST({day} AS VARCHAR), t) ELSE t END AS txt
            FROM messy)
        SELECT event_id, coalesce({sql_units('num')} / 100::DOUBLE, num) AS num, txt FROM cells"""


def _canon_cells(spark, sf_dir, profile):
    messy = table(spark, sf_dir, "events").select(
        "event_id", F.expr(_MESSY.format(text="STRING")).alias("raw"), F.lit("string").alias("kind")
    )
    return results.canonical_cells(messy, profile).withColumn("num", F.expr(canon.round_number("num")))


@query("canon_cells", _canon_sql("lenient"))
def canon_cells(spark, sf_dir):
    return _canon_cells(spark, sf_dir, "lenient")


@query("canon_cells_strict", _canon_sql("strict"))
def canon_cells_strict(spark, sf_dir):
    return _canon_cells(spark, sf_dir, "strict")


_CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query(
    "canon_round",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {_CHARGE.replace('1 ', '1::DOUBLE ')} AS x, l_quantity / 8 AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, {sql_units('x')} AS charge_units, {sql_units('y')} AS eighth_units FROM c""",
)
def canon_round(spark, sf_dir):
    """Rounding of products and of exact ties."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr(canon.round_units(f"({_CHARGE})")).alias("charge_units"),
        F.expr(canon.round_units("(l_quantity / 8D)")).alias("eighth_units"),
    )


_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_TEXTS = ("l_returnflag", "l_linestatus", "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)")


@query(
    "canon_lineitem",
    " UNION ALL ".join(
        [
            f"SELECT {i} AS col_no, 'number' AS kind, count(*) AS n, CAST(sum(CAST(round_even({c} * 100, 0) AS BIGINT)) AS BIGINT) AS units, "
            f"CAST(NULL AS BIGINT) AS text_length FROM lineitem"
            for i, c in enumerate(_LINE_NUMBERS)
        ]
        + [
            f"SELECT {i + 8} AS col_no, '{'timestamp' if i == 2 else 'string'}' AS kind, count(*) AS n, CAST(NULL AS BIGINT) AS units, "
            f"CAST(sum(length({c})) AS BIGINT) AS text_length FROM lineitem"
            for i, c in enumerate(_LINE_TEXTS)
        ]
    ),
)
def canon_lineitem(spark, sf_dir):
    """All cells of lineitem through the long table and its canonical form, summed up by column."""
    lines = table(spark, sf_dir, "lineitem")
    cells = results.to_cells(lines, F.lit("lineitem"), "expected", lines.columns)
    return (
        results.canonical_cells(cells.select("col_no", "raw", "kind", F.col("kind").alias("source")))
        .select("col_no", F.col("source").alias("kind"), F.expr(canon.round_units("num")).alias("units"), "txt")
        .groupBy("col_no", "kind")
        .agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum(F.length("txt").cast("bigint")).alias("text_length"))
    )


@query(
    "to_cells",
    """
    SELECT c_mktsegment AS case_id, 'expected' AS side, c_custkey AS row_no, 0 AS col_no, CAST(c_custkey AS VARCHAR) AS raw, 'number' AS kind FROM customer
    UNION ALL SELECT c_mktsegment, 'expected', c_custkey, 1, c_name, 'string' FROM customer
    UNION ALL SELECT c_mktsegment, 'expected', c_custkey, 2, CAST(c_acctbal AS VARCHAR), 'number' FROM customer
    UNION ALL SELECT c_mktsegment, 'expected', c_custkey, 3, CASE WHEN c_nationkey <> 7 THEN CAST(c_nationkey AS VARCHAR) END,
        CASE WHEN c_nationkey <> 7 THEN 'number' ELSE 'null' END FROM customer""",
)
def to_cells(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.expr("nullif(c_nationkey, 7)"))
    return results.to_cells(
        customer, "c_mktsegment", "expected", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"], row_no="c_custkey"
    )


@query(
    "rows_from_cells",
    f"""SELECT c_mktsegment AS case_id, 'n' || CAST(c_custkey * 100 AS VARCHAR) || ' t' || c_name || ' n' ||
        CAST({sql_units('c_acctbal')} AS VARCHAR) || CASE WHEN c_nationkey <> 7 THEN ' n' || CAST(c_nationkey * 100 AS VARCHAR) ELSE ' z' END AS row_code
        FROM customer""",
)
def rows_from_cells(spark, sf_dir):
    rows = results.rows_from_cells(to_cells(spark, sf_dir))
    return results.coded(rows).select("case_id", F.array_join("codes", " ").alias("row_code"))


@query(
    "shape_class",
    """
    WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
    SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'expected' AS side, CAST(n AS BIGINT) AS n_rows, CASE WHEN n > 0 THEN 1 ELSE 0 END AS n_cols,
           'ok' AS status, CASE WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'scalar' ELSE 'column_vector' END AS shape FROM n
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), 'actual', CAST(n AS BIGINT), CASE WHEN n > 0 THEN 2 ELSE 0 END, 'ok',
           CASE WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'row_vector' ELSE 'table' END FROM n""",
)
def shape_class(spark, sf_dir):
    """Orders of each customer, as one column and as two."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    coded = results.coded_from_frame(orders, "o_custkey", "expected", ["o_orderkey"]).union(
        results.coded_from_frame(orders, "o_custkey", "actual", ["o_orderkey", "o_totalprice"])
    )
    declared = customer.select(
        F.col("c_custkey").cast("string").alias("case_id"), F.explode(F.array(*map(F.lit, results.SIDES))).alias("side")
    ).withColumn("status", F.lit("ok"))
    return results.shape_class(results.complete_sides(coded, declared, "codes"))


_COLLECTION = """CASE event_id % 5
    WHEN 0 THEN concat('[''', event_type, ''', ', CAST(event_id AS {text}), ', None]')
    WHEN 1 THEN concat('("', event_type, '", ', CAST(user_id AS {text}), ',)')
    WHEN 2 THEN props WHEN 3 THEN concat('[', event_type) ELSE concat('[[', CAST(user_id AS {text}), '], [True]]') END"""


@query(
    "parse_arrays",
    """SELECT event_id,
        CASE event_id % 5 WHEN 2 THEN 'object' WHEN 3 THEN 'text' ELSE 'array' END AS kind,
        CASE event_id % 5 WHEN 0 THEN event_type || '|' || CAST(event_id AS VARCHAR) || '|~'
             WHEN 1 THEN event_type || '|' || CAST(user_id AS VARCHAR)
             WHEN 4 THEN '[' || CAST(user_id AS VARCHAR) || ']|[true]' END AS items
        FROM events""",
)
def parse_arrays(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select("event_id", F.expr(_COLLECTION.format(text="STRING")).alias("t"))
    events = texts.select(
        "event_id", F.expr(canon.parse_collection("t")).alias("v")
    )
    kind = F.schema_of_variant("v")
    items = F.transform(
        F.try_variant_get("v", "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("~"))
    )
    return events.select(
        "event_id",
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("text").alias("kind"),
        F.array_join(items, "|").alias("items"),
    )


@query(
    "json_result_rows",
    f"""
    SELECT CAST(event_id AS VARCHAR) AS case_id, 't' || event_type || ' n' || CAST({sql_units('value')} AS VARCHAR) AS row_code
    FROM events WHERE event_id % 4 IN (0, 3)
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'n' || CAST(user_id * 100 AS VARCHAR) || ' z' FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT CAST(event_id AS VARCHAR), 't' || event_type FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'tk n' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS VARCHAR)
    FROM events WHERE event_id % 4 = 2""",
)
def json_result_rows(spark, sf_dir):
    """Results stored as JSON in four forms: rows, scalar, object, list of objects."""
    value = F.to_json(F.struct(F.col("event_type").alias("a"), F.col("value").alias("b")))
    output = F.expr(
        """CASE event_id % 4
           WHEN 0 THEN concat('[["', event_type, '",', CAST(value AS STRING), '],[', CAST(user_id AS STRING), ',null]]')
           WHEN 1 THEN event_type WHEN 2 THEN props END"""
    )
    events = table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(output, F.concat(F.lit("["), value, F.lit("]"))).alias("output")
    )
    rows, _ = results.rows_from_json(events, "event_id", "expected")
    return results.coded(rows).select("case_id", F.array_join("codes", " ").alias("row_code"))


@query(
    "parse_quoted",
    """SELECT conv_id, turn, 'a (' || role || ') True|it''s|say "' || turn || '", ]|true|~' AS items FROM conversations""",
)
def parse_quoted(spark, sf_dir):
    """Marks and words of Python inside strings stay as they are."""
    text = """concat("['a (", role, ") True', \\"it's\\", 'say \\"", turn, "\\", ]', True, None, ]")"""
    lists = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(text).alias("t"))
    value = F.try_variant_get(F.expr(canon.parse_collection("t")), "$", "array<variant>")
    items = F.transform(value, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("~")))
    return lists.select("conv_id", "turn", F.array_join(items, "|").alias("items"))
