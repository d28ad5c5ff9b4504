"""Extraction from response texts built over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query, sql_strip, table
from concord.functions import text

# Responses in the forms a model gives them, around the whole text of a turn.
RESPONSE = """CASE (conv_id + turn) % 9
    WHEN 0 THEN concat('<think>plan: SELECT ', role, '</think>', {nl}, '```sql', {nl}, 'SELECT ', CAST(turn AS {text}), ' AS x;', {nl}, '```', text)
    WHEN 1 THEN concat('Here: ```SQL SELECT ', CAST(conv_id AS {text}), {nl}, text)
    WHEN 2 THEN concat('```', 'SELECT c FROM t;', {nl}, '```', text)
    WHEN 3 THEN concat('The answer is', {nl}, '-- note', {nl}, 'select a', {nl}, {nl}, '# c', {nl}, '  from t; ', {nl}, text)
    WHEN 4 THEN text
    WHEN 5 THEN concat('WITH q AS (SELECT 1) SELECT * FROM q', {nl}, 'WHERE ', CAST(turn AS {text}), ' = 1;', {nl}, '-- ', text)
    WHEN 6 THEN concat('a</think>b</think>```sqlite', {nl}, 'SELECT 2 ; ', {nl}, text, '```')
    WHEN 7 THEN concat('```Python', {nl}, 'import pandas as pd', {nl}, 'a = pd.read_csv("data/orders.csv", sep=",")', {nl},
                       'b = pandas.read_csv(''Customer.csv'')', {nl}, 'c = pd.read_csv("x/myorders.csv")', {nl}, '```', text)
    ELSE concat('<think>', text) END"""

# Answers of the second phase, as JSON and as prose; within JSON, line breaks, tabs, quotes and backslashes of the text are spaces.
_WITHIN = "translate(text, concat(chr(10), chr(9), chr(13), chr(34), chr(92)), '     ')"
ANSWER = f"""CASE (conv_id + turn) % 7
    WHEN 0 THEN concat('```json', {{nl}}, '{{{{"classification": ["Join & Relationship Logic", "Scope"], "answer": "turn ', CAST(turn AS {{text}}), ' ', {_WITHIN}, '"}}}}', {{nl}}, '```')
    WHEN 1 THEN concat('{{{{"classification": "Constraint", "answer": "c', CAST(conv_id AS {{text}}), ' ', {_WITHIN}, '"}}}}')
    WHEN 2 THEN concat('```', {{nl}}, '{{{{"answer": "no class ', {_WITHIN}, '"}}}}', {{nl}}, '```')
    WHEN 3 THEN concat('[Domain Concept], [abc] and Calculation Logic: see [ Domain Concept ] ', role, ' ', text)
    WHEN 4 THEN text
    WHEN 5 THEN concat('{{{{"classification": ["broken", "', text)
    ELSE concat(role, ' only ', text) END"""


def spark_expr(template: str) -> F.Column:
    return F.expr(template.format(text="STRING", nl="'\\n'"))


def duck_expr(template: str) -> str:
    return template.format(text="VARCHAR", nl="chr(10)")


def responses(spark, sf_dir, template: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spark_expr(template).alias("r"))


def _base(template: str) -> str:
    return f"WITH r AS (SELECT conv_id, turn, {duck_expr(template)} AS r FROM conversations)"


_REASONED = (
    f"CASE WHEN contains(r, '</think>') THEN {sql_strip(chr(39).join(['regexp_replace(r, ', '(?s)^.*</think>', ', ', '', ')']))} ELSE r END"
)


@query("strip_reasoning", f"{_base(RESPONSE)} SELECT conv_id, turn, {_REASONED} AS body FROM r")
def strip_reasoning(spark, sf_dir):
    return responses(spark, sf_dir, RESPONSE).select("conv_id", "turn", text.strip_reasoning(F.col("r")).alias("body"))


EXTRACT_SQL = f"""
    b AS (SELECT conv_id, turn, {_REASONED} AS b FROM r),
    c AS (SELECT *, {sql_strip('b')} AS t FROM b),
    d AS (SELECT *, regexp_extract(t, '(?is)((?:\\bwith\\s+(?:recursive\\s+)?\\w+\\s*(?:\\([^)]*\\)\\s*)?as\\s*\\(|select).*)', 1) AS f FROM c),
    e AS (SELECT *, CASE WHEN f <> '' THEN f ELSE t END AS cut FROM d),
    l AS (SELECT *, list_filter(list_transform(string_split(cut, chr(10)), lambda x: {sql_strip('x')}),
              lambda x: x <> '' AND NOT starts_with(x, '--') AND NOT starts_with(x, '#')) AS lines FROM e),
    s AS (SELECT conv_id, turn, {sql_strip('''CASE
              WHEN regexp_matches(b, '(?i)```sql') THEN regexp_extract(b, '(?is)```sql(?:ite)?(.*?)(?:```|\\z)', 1)
              WHEN contains(b, '```') THEN regexp_extract(b, '(?s)```(.*?)(?:```|\\z)', 1)
              WHEN len(lines) > 0 THEN array_to_string(lines, ' ') ELSE cut END''')} AS q FROM l),
    sql_of AS (SELECT conv_id, turn, {sql_strip("CASE WHEN ends_with(q, ';') THEN left(q, length(q) - 1) ELSE q END")} AS sql FROM s)"""


@query("extract_sql", f"{_base(RESPONSE)}, {EXTRACT_SQL} SELECT conv_id, turn, sql FROM sql_of")
def extract_sql(spark, sf_dir):
    return responses(spark, sf_dir, RESPONSE).select("conv_id", "turn", text.extract_sql(F.col("r")).alias("sql"))


EXTRACT_CODE = f"""
    b AS (SELECT conv_id, turn, {_REASONED} AS b FROM r),
    code_of AS (SELECT conv_id, turn, {sql_strip('''CASE
        WHEN regexp_matches(b, '(?i)```python') THEN regexp_extract(b, '(?is)```python(.*?)(?:```|\\z)', 1)
        WHEN contains(b, '```') THEN regexp_extract(b, '(?s)```(.*?)(?:```|\\z)', 1) ELSE b END''')} AS code FROM b)"""


@query("extract_code", f"{_base(RESPONSE)}, {EXTRACT_CODE} SELECT conv_id, turn, code FROM code_of")
def extract_code(spark, sf_dir):
    return responses(spark, sf_dir, RESPONSE).select("conv_id", "turn", text.extract_code(F.col("r")).alias("code"))


_TABLES = ["customer", "orders", "nation"]
_READS = """(?i)(?:pd|pandas)\\.read_csv\\s*\\(\\s*[''"](?:[^''"]*[/\\\\])?"""


@query(
    "table_refs",
    f"""{_base(RESPONSE)}, {EXTRACT_CODE},
    seen AS (SELECT conv_id, turn, list_transform(regexp_extract_all(code, '{_READS}([^''"/\\\\]+)\\.csv[''"]', 1), lambda x: lower(x)) AS names FROM code_of)
    SELECT conv_id, turn, array_to_string(list_filter(['customer', 'orders', 'nation'], lambda t: list_contains(names, t)), ',') AS tables,
    FROM seen""",
)
def table_refs(spark, sf_dir):
    refs = text.table_refs(text.extract_code(F.col("r")), _TABLES)
    return responses(spark, sf_dir, RESPONSE).select("conv_id", "turn", F.array_join(refs, ",").alias("tables"))


def _rewritten(code: str) -> str:
    for name in _TABLES:
        code = f"regexp_replace({code}, '{_READS}{name}\\.csv[''\"]\\s*(?:,[^)]*)?\\)', '{name}_df', 'g')"
    return code


@query("rewrite_reads", f"{_base(RESPONSE)}, {EXTRACT_CODE} SELECT conv_id, turn, {_rewritten('code')} AS code FROM code_of")
def rewrite_reads(spark, sf_dir):
    code = text.rewrite_table_reads(text.extract_code(F.col("r")), _TABLES)
    return responses(spark, sf_dir, RESPONSE).select("conv_id", "turn", code.alias("code"))


_CLEANED = "r"
for _fence in ("^```json", "^```", "```$"):
    _CLEANED = f"regexp_replace({sql_strip(_CLEANED) if _CLEANED == 'r' else _CLEANED}, '{_fence}', '')"
JSON_OF = f"j AS (SELECT conv_id, turn, r, CASE WHEN json_valid({sql_strip(_CLEANED)}) THEN {sql_strip(_CLEANED)} END AS j FROM r)"


@query(
    "extract_answer",
    f"{_base(ANSWER)}, {JSON_OF} SELECT conv_id, turn, coalesce(json_extract_string(j, '$.answer'), r) AS answer FROM j",
)
def extract_answer(spark, sf_dir):
    return responses(spark, sf_dir, ANSWER).select("conv_id", "turn", text.extract_answer(F.col("r")).alias("answer"))


CATEGORIES = f"""{JSON_OF},
    w AS (SELECT *, list_filter(list_transform(list_concat(regexp_extract_all(r, '\\[([^\\]]+)\\]', 1),
             regexp_extract_all(r, '([A-Za-z &]+):\\s', 1)), lambda x: {sql_strip('x')}), lambda x: length(x) > 3) AS words FROM j),
    cats AS (SELECT conv_id, turn, CASE
        WHEN json_type(j, '$.classification') = 'ARRAY' THEN json_extract_string(j, '$.classification[*]')
        WHEN json_type(j, '$.classification') = 'VARCHAR' THEN [json_extract_string(j, '$.classification')]
        WHEN len(words) > 0 THEN list_sort(list_distinct(words)) ELSE ['Unclassified'] END AS cats FROM w)"""


@query("extract_categories", f"{_base(ANSWER)}, {CATEGORIES} SELECT conv_id, turn, array_to_string(cats, '|') AS categories FROM cats")
def extract_categories(spark, sf_dir):
    categories = text.extract_categories(F.col("r"))
    return responses(spark, sf_dir, ANSWER).select("conv_id", "turn", F.array_join(categories, "|").alias("categories"))


@query(
    "category_counts",
    f"""{_base(ANSWER)}, {CATEGORIES}, x AS (SELECT unnest(cats) AS category FROM cats)
    SELECT category, count(*) AS n FROM x GROUP BY category""",
)
def category_counts(spark, sf_dir):
    exploded = responses(spark, sf_dir, ANSWER).select(F.explode(text.extract_categories(F.col("r"))).alias("category"))
    return exploded.groupBy("category").agg(F.count("*").alias("n"))


_JUDGED = """CASE (conv_id + turn) % 5 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Incorrect' WHEN 2 THEN concat('Correct. ', text)
    WHEN 3 THEN concat('error: ', role) ELSE NULL END"""


@query(
    "judge_parse",
    f"""{_base(_JUDGED)} SELECT conv_id, turn,
    CAST(coalesce(contains(r, 'Correct') AND NOT contains(r, 'Incorrect'), FALSE) AS INTEGER) AS res FROM r""",
)
def judge_parse(spark, sf_dir):
    return responses(spark, sf_dir, _JUDGED).select("conv_id", "turn", text.judge_verdict(F.col("r")).alias("res"))


_FAILED = """CASE event_id % 6 WHEN 0 THEN 'Read Timeout after 30s' WHEN 1 THEN 'division by zero' WHEN 2 THEN 'SSL handshake'
    WHEN 3 THEN NULL WHEN 4 THEN concat('bad ', event_type) ELSE concat('no column ', props) END"""
_FAILED_TYPE = "CASE WHEN event_id % 6 = 4 THEN 'ConnectionResetError ConnectionError OSError Exception' ELSE 'ValueError Exception' END"


@query(
    "failure_class",
    f"""WITH f AS (SELECT event_id, {_FAILED} AS error, {_FAILED_TYPE} AS error_type FROM events)
    SELECT event_id, CASE WHEN error IS NULL THEN NULL
        WHEN regexp_matches(lower(error), '{"|".join(text.TRANSIENT_WORDS)}')
          OR regexp_matches(error_type, '\\b({"|".join(text.TRANSIENT_CLASSES)})\\b') THEN 'transient' ELSE 'permanent' END AS failure FROM f""",
)
def failure_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.classify_failure(F.expr(_FAILED), F.expr(_FAILED_TYPE)).alias("failure")
    )
