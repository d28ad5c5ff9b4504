"""Column expressions against plain Python readings of the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from concord.functions import canon, records, text
from concord.operators import results


def values(spark, column_of, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column_of(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rounding_is_that_of_decimals(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-1000, 1000) for _ in range(3000)]
    xs += [i / 1000 for i in range(-3000, 3000, 5)] + [i / 8 for i in range(-400, 400)]
    xs += [10 ** rng.uniform(9, 14) for _ in range(1000)] + [1.005, 1.015, 0.125, -0.0, 1e300]
    df = spark.createDataFrame([(x, round(x, 2), round(x, 0)) for x in xs], "x double, two double, zero double")
    got = df.select("x", "two", "zero", F.expr(canon.round_number("x")).alias("r2"), F.expr(canon.round_number("x", 0)).alias("r0"))
    assert got.filter("two <> r2 OR zero <> r0").count() == 0


@pytest.mark.parametrize("profile", ["strict", "lenient"])
def test_cells_by_text_and_by_type_agree(spark, profile):
    """The long cell table, typed frames and coded frames give the same codes."""
    df = spark.sql(
        """SELECT * FROM VALUES
        (1, 9007199254740993L, 1.005D, ' 007', true, DATE'2024-02-01', 12.345BD),
        (2, 5L, double('NaN'), 'yes', false, NULL, NULL),
        (3, -90071992547410L, 1e17D, '2024/1/5', NULL, DATE'1999-12-31', -0.005BD),
        (4, 100000000000000000L, 90071992547410D, 'None', true, DATE'2000-01-01', 0BD),
        (5, NULL, -0.0D, NULL, NULL, NULL, 7BD),
        (6, 1L, 9.1e18D, '90071992547409931', NULL, NULL, 7BD)
        AS t(k, a, b, c, d, e, f)"""
    )
    cols = ["a", "b", "c", "d", "e", "f"]
    show = lambda coded: sorted(tuple(r.codes) for r in coded.collect())
    direct = show(results.coded_from_frame(df, "k", "expected", cols, profile))
    assert show(results.coded(results.rows_from_frame(df, "k", "expected", cols, profile))) == direct
    cells = results.to_cells(df, "k", "expected", cols, row_no="k")
    assert show(results.coded(results.rows_from_cells(cells, profile))) == direct
    by_a = {r[0]: r for r in direct}
    assert by_a["t9007199254740993"][1:3] == ("n100", "n700")
    assert by_a["t100000000000000000"][1] == "t90071992547410"
    assert by_a["n500"][2] == ("n100" if profile == "lenient" else "tyes")


def test_wide_frames_code_every_column(spark):
    df = spark.range(5).select(
        F.col("id").alias("k"), *[(F.col("id") + i + 0.125).alias(f"d{i}") for i in range(40)],
        *[F.concat(F.lit(" t"), F.col("id") * i).alias(f"s{i}") for i in range(20)],
    )
    rows = {r.case_id: r.codes for r in results.coded_from_frame(df, "k", "expected").collect()}
    assert rows["2"][:2] == ["n212", "n312"] and rows["2"][40:43] == ["tt0", "tt2", "tt4"] and len(rows["2"]) == 60


def test_extract_sql(spark):
    cases = {
        "```sql\nSELECT 1;\n```": "SELECT 1",
        "x </think> ```SQL\nSELECT 2": "SELECT 2",
        "```\nfoo\n``` bar": "foo",
        "Sure:\nselect a\n-- c\n\n# d\n from t;;": "select a from t;",
        "no query here": "no query here",
        "WITH a AS (SELECT 1) SELECT * FROM a;": "WITH a AS (SELECT 1) SELECT * FROM a",
        "```sqlite\nSELECT 3\n```": "SELECT 3",
        "": "",
    }
    assert values(spark, text.extract_sql, cases) == list(cases.values())


def test_extract_code(spark):
    cases = {
        "```python\nx = 1\n```": "x = 1", "```Python\nx = 2\n```rest": "x = 2", "``` x = 3 ```": "x = 3",
        "x = 4": "x = 4", "<think>```python\nno```</think> x = 5": "x = 5",
    }
    assert values(spark, text.extract_code, cases) == list(cases.values())


def test_answers_and_categories(spark):
    cases = {
        '```json\n{"classification": ["A b", "C"], "answer": "yes"}\n```': ("yes", ["A b", "C"]),
        '{"classification": "One", "answer": 5}': ("5", ["One"]),
        '{"other": "[Domain Name]"}': ('{"other": "[Domain Name]"}', ["Domain Name"]),
        "[Zed Logic] and [abc] Calculation Rules: x [Zed Logic]": (None, ["Zed Logic", "and [abc] Calculation Rules"]),
        "nothing": ("nothing", ["Unclassified"]),
    }
    answers = values(spark, text.extract_answer, cases)
    categories = values(spark, text.extract_categories, cases)
    for (source, (answer, _)), got in zip(cases.items(), answers):
        assert got == (answer or source)
    assert categories[:3] == [c for _, c in list(cases.values())[:3]]
    assert categories[3] == ["Calculation Rules", "Zed Logic"] and categories[4] == ["Unclassified"]


def test_table_reads(spark):
    code = "a = pd.read_csv('d/t.csv')\nb = PANDAS.read_csv( \"T.csv\", sep=';' )\nc = pd.read_csv('mytable.csv')\nd = pd.read_csv('table.csv')"
    assert values(spark, lambda c: text.table_refs(c, ["t", "table", "u"]), [code]) == [["t", "table"]]
    assert values(spark, lambda c: text.rewrite_table_reads(c, ["t", "table"]), [code]) == [
        "a = t_df\nb = t_df\nc = pd.read_csv('mytable.csv')\nd = table_df"
    ]


def test_judge_and_failures(spark):
    assert values(spark, text.judge_verdict, ["Correct", "Incorrect", "It is Correct.", "error: x", None]) == [1, 0, 1, 0, 0]
    errors = ["Connection refused", "KeyError: 'a'", None, "unexpected EOF"]
    assert values(spark, text.classify_failure, errors) == ["transient", "permanent", None, "transient"]
    typed = lambda c: text.classify_failure(c, F.lit("FileNotFoundError OSError Exception"))
    assert values(spark, typed, ["no such file"]) == ["transient"]


def test_records(spark):
    wire = lambda c: records.decode_prediction(records.encode_prediction(c, F.lit("db"), "\t|\t"), "\t|\t")
    assert [tuple(v) for v in values(spark, wire, ["SELECT 1", ""])] == [("SELECT 1", "db"), ("", "db")]
    assert values(spark, records.database_of, ["a/b/shop.sqlite", "shop"]) == ["shop", "shop"]
    assert values(spark, lambda c: records.first_nonempty([F.lit(""), c]), ['["a","b"]', "[]", "", None, "x"]) == [
        "a", None, None, None, "x",
    ]
    assert values(spark, records.ensure_select_prefix, ["a FROM b", "Select 1", "with q as (x)", ""]) == [
        "SELECT a FROM b", "Select 1", "with q as (x)", "",
    ]
