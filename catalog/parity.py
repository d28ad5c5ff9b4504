"""Comparison levels and verdicts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, sql_cents, table
from concord.operators import cases as C
from concord.operators import parity, results
from concord.session import materialise

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

# The produced side gets some quantities wrong.
_WRONG_QUANTITY = "CASE WHEN l_linestatus = 'O' AND l_tax = 0.08 THEN l_quantity + 1 ELSE l_quantity END"


def _coded_lines(spark, sf_dir, case):
    lines = table(spark, sf_dir, "lineitem").withColumn("case_key", case)
    wrong = lines.withColumn("l_quantity", F.expr(_WRONG_QUANTITY))
    return results.coded_from_frame(lines, "case_key", "expected", _LINE).union(
        results.coded_from_frame(wrong, "case_key", "actual", _LINE)
    )


def _multiset_sql(case: str) -> str:
    def cols(quantity):
        return ", ".join(
            f"{sql_cents(quantity if c == 'l_quantity' else c)} AS {c}"
            if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
            else f"CAST(l_shipdate AS DATE) AS {c}" if c == "l_shipdate" else c
            for c in _LINE
        )
    keys = ", ".join(_LINE)
    return f"""
        WITH both_sides AS (
            SELECT {case} AS case_id, 1 AS e, 0 AS a, {cols('l_quantity')} FROM lineitem
            UNION ALL
            SELECT {case} AS case_id, 0 AS e, 1 AS a, {cols('(' + _WRONG_QUANTITY + ')')} FROM lineitem),
        weighed AS (SELECT case_id, sum(e) AS n_e, sum(a) AS n_a FROM both_sides GROUP BY case_id, {keys})
        SELECT case_id, CAST(sum(abs(n_e - n_a)) AS BIGINT) AS diff_rows FROM weighed GROUP BY case_id"""


@query("parity_multiset", _multiset_sql("l_returnflag"))
def parity_multiset(spark, sf_dir):
    return parity.diff_multiset(_coded_lines(spark, sf_dir, F.col("l_returnflag")))


@query("parity_multiset_one_case", _multiset_sql("'lineitem'"))
def parity_multiset_one_case(spark, sf_dir):
    return parity.diff_multiset(_coded_lines(spark, sf_dir, F.lit("lineitem")))


@query("parity_multiset_many_cases", _multiset_sql("CAST(l_suppkey AS VARCHAR)"))
def parity_multiset_many_cases(spark, sf_dir):
    return parity.diff_multiset(_coded_lines(spark, sf_dir, F.col("l_suppkey")))


@query(
    "parity_differing_rows",
    """
    WITH e AS (SELECT o_orderpriority AS case_id, o_custkey, o_orderstatus, count(*) AS n_e FROM orders GROUP BY ALL),
    a AS (SELECT o_orderpriority AS case_id, o_custkey, o_orderstatus, count(*) AS n_a FROM orders
          WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 400000) GROUP BY ALL)
    SELECT case_id, 'n' || CAST(o_custkey * 100 AS VARCHAR) || ' t' || o_orderstatus AS row_code,
           CAST(n_e AS BIGINT) AS n_e, CAST(coalesce(n_a, 0) AS BIGINT) AS n_a
    FROM e LEFT JOIN a USING (case_id, o_custkey, o_orderstatus) WHERE n_e <> coalesce(n_a, 0)""",
)
def parity_differing_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept = orders.filter("NOT (o_orderstatus = 'P' AND o_totalprice > 400000)")
    cols = ["o_custkey", "o_orderstatus"]
    coded = results.coded_from_frame(orders, "o_orderpriority", "expected", cols).union(
        results.coded_from_frame(kept, "o_orderpriority", "actual", cols)
    )
    return parity.differing_rows(coded).select("case_id", F.array_join("codes", " ").alias("row_code"), "n_e", "n_a")


@query(
    "parity_set",
    """
    WITH e AS (SELECT DISTINCT o_orderpriority AS case_id, o_custkey, o_orderstatus FROM orders),
    a AS (SELECT DISTINCT o_orderpriority AS case_id, o_custkey, o_orderstatus FROM orders
          WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e)),
    cases AS (SELECT DISTINCT case_id FROM e)
    SELECT case_id, CAST(count(d.o_custkey) AS BIGINT) AS diff_rows FROM cases LEFT JOIN d USING (case_id) GROUP BY case_id""",
)
def parity_set(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cols = ["o_custkey", "o_orderstatus"]
    once = orders.filter("NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')").select("o_orderpriority", *cols).distinct()
    coded = results.coded_from_frame(orders, "o_orderpriority", "expected", cols).union(
        results.coded_from_frame(once, "o_orderpriority", "actual", cols)
    )
    return parity.diff_set(coded)


_PROJECTION_SQL = """
    WITH e AS (SELECT DISTINCT l_returnflag AS case_id, l_partkey, {price} AS price, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    a AS (SELECT DISTINCT l_returnflag AS case_id, l_partkey,
                 CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN {price} + 100 ELSE {price} END AS price,
                 CAST(l_shipdate AS DATE) AS d FROM lineitem),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e))
    SELECT case_id, CAST(case_id NOT IN (SELECT case_id FROM d) AS INTEGER) AS res FROM (SELECT DISTINCT case_id FROM e)"""


@query("parity_projection", _PROJECTION_SQL.format(price=sql_cents("l_extendedprice")))
def parity_projection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    narrow = lines.withColumn(
        "l_extendedprice",
        F.expr("CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END"),
    )
    coded = results.coded_from_frame(narrow, "l_returnflag", "expected", ["l_partkey", "l_extendedprice", "l_shipdate"]).union(
        results.coded_from_frame(lines.withColumn("flag", F.col("l_returnflag")), "flag", "actual", _LINE)
    )
    weighed = materialise(parity.weigh(coded), "weighed")
    found = parity.match_projection(weighed).select("case_id", F.lit(1).alias("found"))
    cases = lines.select(F.col("l_returnflag").alias("case_id")).distinct()
    return cases.join(found, "case_id", "left").select("case_id", F.coalesce("found", F.lit(0)).alias("res"))


@query(
    "parity_flat",
    f"""
    WITH e AS (SELECT DISTINCT o_orderkey AS k, unnest([CAST(o_custkey * 100 AS VARCHAR), o_orderstatus,
                      CAST({sql_cents('o_totalprice')} AS VARCHAR)]) AS v FROM orders),
    a AS (SELECT DISTINCT o_orderkey AS k, unnest([CAST(o_custkey * 100 AS VARCHAR), o_orderstatus,
                      CAST({sql_cents("CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END")} AS VARCHAR)]) AS v FROM orders),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e))
    SELECT CAST(k AS VARCHAR) AS case_id, CAST(count(v) AS BIGINT) AS diff_rows
    FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN d USING (k) GROUP BY k""",
)
def parity_flat(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wrong = orders.withColumn("o_totalprice", F.expr("CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END"))
    column = wrong.select(
        "o_orderkey",
        F.explode(F.array(*[F.col(c).cast("string") for c in ("o_custkey", "o_orderstatus", "o_totalprice")])).alias("v"),
    )
    coded = results.coded_from_frame(orders, "o_orderkey", "expected", ["o_custkey", "o_orderstatus", "o_totalprice"]).union(
        results.coded_from_frame(column, "o_orderkey", "actual", ["v"])
    )
    return parity.diff_flat(parity.weigh(coded))


@query(
    "parity_scaled",
    f"""
    WITH e AS (SELECT DISTINCT l_returnflag AS case_id, l_orderkey, l_linenumber, {sql_cents('l_discount')} AS v FROM lineitem),
    a AS (SELECT DISTINCT l_returnflag AS case_id, l_orderkey, l_linenumber,
                 {sql_cents('l_discount')} + CASE WHEN l_returnflag = 'R' AND l_tax = 0 AND l_discount < 0.1 THEN 1 ELSE 0 END AS v
          FROM lineitem),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e))
    SELECT case_id, CAST(count(d.v) AS BIGINT) AS diff_rows
    FROM (SELECT DISTINCT case_id FROM e) LEFT JOIN d USING (case_id) GROUP BY case_id""",
)
def parity_scaled(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    percent = lines.withColumn(
        "l_discount",
        F.expr("round(l_discount * 100, 0) + CASE WHEN l_returnflag = 'R' AND l_tax = 0 AND l_discount < 0.1 THEN 1 ELSE 0 END"),
    ).withColumn("l_discount", F.concat(F.col("l_discount").cast("string"), F.lit("%")))
    cols = ["l_orderkey", "l_linenumber", "l_discount"]
    rows = results.rows_from_frame(lines, "l_returnflag", "expected", cols).union(
        results.rows_from_frame(percent, "l_returnflag", "actual", cols)
    )
    return parity.diff_scaled(rows, tol=0)


# Every price and charge is one cent off at most, by the row's keys; one row of flag R is two cents beyond the highest price.
_CENT_OFF = "((l_orderkey * {a} + l_linenumber * {b}) % 3 - 1)"


@query(
    "tolerant_many",
    """SELECT l_returnflag AS case_id, CAST(l_returnflag <> 'R' AS INTEGER) AS res, CAST(count(*) AS BIGINT) AS n_rows
    FROM lineitem GROUP BY l_returnflag""",
)
def tolerant_many(spark, sf_dir):
    """Two money columns of all lineitem with a cent of noise and no key column; one planted row is two cents off."""
    lines = table(spark, sf_dir, "lineitem")
    price, charge = "round(l_extendedprice * 100)", "round(l_extendedprice * l_tax * 10)"
    exact = lines.selectExpr("l_returnflag", f"{price} AS p", f"{charge} AS c", f"{_CENT_OFF.format(a=1, b=1)} AS dp", f"{_CENT_OFF.format(a=2, b=1)} AS dc")
    top = exact.groupBy("l_returnflag").agg(F.max(F.struct("p", "c", "dp", "dc")).alias("top"), F.count("*").cast("bigint").alias("n_rows"))
    top = materialise(top, "top-rows")
    planted = F.when((F.col("l_returnflag") == "R") & (F.struct("p", "c", "dp", "dc") == F.col("top")), 2).otherwise(F.col("dp"))
    noisy = exact.join(top, "l_returnflag").select("l_returnflag", ((F.col("p") + planted) / 100).alias("p"), ((F.col("c") + F.col("dc")) / 100).alias("c"))
    rows = results.rows_from_frame(exact.selectExpr("l_returnflag", "p / 100 AS p", "c / 100 AS c"), "l_returnflag", "expected").union(
        results.rows_from_frame(noisy, "l_returnflag", "actual")
    )
    left = parity.diff_scaled(rows, tol=1).select("case_id", (F.col("diff_rows") == 0).cast("int").alias("res"))
    return left.join(top.select(F.col("l_returnflag").alias("case_id"), "n_rows"), "case_id")


# Shares with four decimals, as ten thousandths, and what the percent side is off by.
_SHARE = "(CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT) + 11)"
_OFF = "CASE WHEN l_tax <> 0 THEN 0 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END"


@query(
    "parity_scaled_tolerant",
    f"""
    WITH v AS (SELECT l_returnflag AS case_id, l_orderkey, l_linenumber, {_SHARE} AS e, {_SHARE} + {_OFF} AS a FROM lineitem),
    e AS (SELECT DISTINCT case_id, l_orderkey, l_linenumber, e AS v FROM v), a AS (SELECT DISTINCT case_id, l_orderkey, l_linenumber, a AS v FROM v),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e)),
    far AS (SELECT DISTINCT case_id FROM v WHERE abs(e - a) > 1)
    SELECT c.case_id, CASE WHEN far.case_id IS NULL THEN 0::BIGINT ELSE (SELECT count(*) FROM d WHERE d.case_id = c.case_id) END AS diff_rows
    FROM (SELECT DISTINCT case_id FROM e) c LEFT JOIN far USING (case_id)""",
)
def parity_scaled_tolerant(spark, sf_dir):
    """Shares against percents, a hundredth of a percent off in flag A, which is equal, and two in flag R."""
    lines = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "share"]
    share = lines.withColumn("share", F.expr(f"{_SHARE} / 10000.0D"))
    percent = lines.withColumn("share", F.expr(f"concat(CAST(({_SHARE} + {_OFF}) / 100.0D AS STRING), '%')"))
    rows = results.rows_from_frame(share, "l_returnflag", "expected", cols).union(
        results.rows_from_frame(percent, "l_returnflag", "actual", cols)
    )
    return parity.diff_scaled(rows, tol=1)


@query(
    "parity_tokens",
    """
    WITH e AS (SELECT DISTINCT c_nationkey AS n, lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment) AS v FROM customer),
    a AS (SELECT DISTINCT c_nationkey AS n, lower(c_custkey || ' ' || c_name || ' ' ||
                 CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE c_mktsegment END) AS v FROM customer),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e))
    SELECT CAST(n AS VARCHAR) AS case_id, CAST(count(v) AS BIGINT) AS diff_rows
    FROM (SELECT DISTINCT n FROM e) LEFT JOIN d USING (n) GROUP BY n""",
)
def parity_tokens(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    joined = customer.select("c_nationkey", "c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("label"))
    split = customer.select(
        "c_nationkey", "c_custkey", F.upper("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "unknown").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    coded = results.coded_from_frame(joined, "c_nationkey", "expected").union(
        results.coded_from_frame(split, "c_nationkey", "actual")
    )
    return parity.diff_tokens(parity.weigh(coded))


# Status counts per priority from all orders against those without the dear open ones.
_SLICE_SQL = """
    WITH e AS (SELECT o_orderpriority AS case_id, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
    a AS (SELECT o_orderpriority AS case_id, o_orderstatus, count(*) AS n FROM orders
          WHERE NOT (o_orderpriority < '3' AND o_orderstatus = 'P' AND o_totalprice > 300000) GROUP BY ALL),
    d AS ((SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM e)),
    per_case AS (SELECT case_id, count(d.n) AS diff FROM (SELECT DISTINCT case_id FROM e) LEFT JOIN d USING (case_id) GROUP BY case_id)
    SELECT case_id, CAST(diff = 0 AS INTEGER) AS res, CASE WHEN diff = 0 THEN 'multiset' ELSE 'none' END AS level,
           CAST(diff AS BIGINT) AS diff_rows, CAST(NULL AS VARCHAR) AS error
    FROM per_case"""


@query("verdicts", _SLICE_SQL)
def verdicts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("concord_orders")
    expected = spark.sql(
        "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM concord_orders GROUP BY o_orderpriority, o_orderstatus"
    )
    actual = (
        orders.filter("NOT (o_orderpriority < '3' AND o_orderstatus = 'P' AND o_totalprice > 300000)")
        .groupBy("o_orderpriority", "o_orderstatus").count()
    )
    coded = results.coded_from_frame(expected, "o_orderpriority", "expected").union(
        results.coded_from_frame(actual, "o_orderpriority", "actual")
    )
    return parity.verdicts_from_coded(coded, results.sides_of(coded, "codes"))


@query(
    "verdicts_lenient",
    f"""
    WITH o AS (SELECT *, {sql_cents('o_totalprice')} AS cents FROM orders),
    sizes AS (SELECT o_orderpriority AS case_id, count(*) AS n, count(DISTINCT (o_custkey, o_orderstatus)) AS n_pairs FROM o GROUP BY 1),
    changed AS (SELECT count(*) AS n FROM o WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F')
    SELECT case_id,
           CAST(case_id <> '5-LOW' OR changed.n = 0 AS INTEGER) AS res,
           CASE case_id WHEN '1-URGENT' THEN 'multiset' WHEN '2-HIGH' THEN 'set' WHEN '3-MEDIUM' THEN 'projection'
                WHEN '4-NOT SPECIFIED' THEN 'tokens' ELSE 'none' END AS level,
           CAST(CASE case_id WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN sizes.n WHEN '3-MEDIUM' THEN 2 * sizes.n
                WHEN '4-NOT SPECIFIED' THEN 2 * sizes.n ELSE 2 * changed.n END AS BIGINT) AS diff_rows,
           CAST(NULL AS VARCHAR) AS error
    FROM sizes, changed""",
)
def verdicts_lenient(spark, sf_dir):
    """Five cases, each decided by another level."""
    orders = table(spark, sf_dir, "orders")
    of = lambda priority: orders.filter(F.col("o_orderpriority") == priority)
    key = "o_orderpriority"
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    rows = lambda df, side, values: results.rows_from_frame(df, key, side, values, "lenient")
    label = F.concat_ws(" ", F.col("o_orderstatus"), F.col("o_orderdate").cast("date").cast("string"))
    day = F.col("o_orderdate").cast("date").cast("string")
    fourth = of("4-NOT SPECIFIED").withColumn("label", F.concat(F.lit("on "), label))
    split = of("4-NOT SPECIFIED").withColumn("status", F.concat(F.lit("on "), F.col("o_orderstatus"))).withColumn("day", day)
    wrong = of("5-LOW").withColumn(
        "o_totalprice", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1000000 ELSE o_totalprice END")
    )
    parts = [
        rows(of("1-URGENT"), "expected", cols), rows(of("1-URGENT"), "actual", cols),
        rows(of("2-HIGH"), "expected", cols), rows(of("2-HIGH").union(of("2-HIGH")), "actual", cols),
        rows(of("3-MEDIUM"), "expected", cols), rows(of("3-MEDIUM"), "actual", ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderkey"]),
        rows(fourth, "expected", ["o_orderkey", "label"]), rows(split, "actual", ["o_orderkey", "status", "day"]),
        rows(of("5-LOW"), "expected", cols), rows(wrong, "actual", cols),
    ]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.union(p)
    everything = materialise(everything, "case-rows")
    return parity.verdicts(everything, results.sides_of(everything), "lenient")


@query(
    "sql_vs_dataframe",
    """
    SELECT * FROM (VALUES
        ('customers per segment', 1, 'multiset', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)),
        ('order value per nation', 1, 'multiset', 0, NULL),
        ('unknown column', 0, 'none', (SELECT count(*) FROM region), 'actual side failed: AnalysisException'),
        ('wrong filter', 0, 'none', (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_nationkey > 0) - 2 *
            (SELECT count(*) FROM nation WHERE n_nationkey > 0), NULL)
    ) AS t(case_id, res, level, diff_rows, error)""",
)
def sql_vs_dataframe(spark, sf_dir):
    """The same questions as SQL and as DataFrame programs."""
    names = ("customer", "orders", "nation", "region")
    tables = {n: table(spark, sf_dir, n) for n in names}
    cases = [
        C.Case("customers per segment", "shop", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment",
               lambda t: t["customer"].groupBy("c_mktsegment").count()),
        C.Case("order value per nation", "shop",
               "SELECT n_name, max(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey "
               "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
               lambda t: t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
               .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.max("o_totalprice"))),
        C.Case("unknown column", "shop", "SELECT r_name FROM region", lambda t: t["region"].select("r_title")),
        C.Case("wrong filter", "shop", "SELECT n_name FROM nation", lambda t: t["nation"].filter("n_nationkey > 0").select("n_name")),
    ]
    rows, sides = C.run_cases(spark, cases, {"shop": tables})
    return parity.verdicts(rows, sides)


@query(
    "verdicts_lenient_one_case",
    f"""
    WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, {sql_cents('l_extendedprice')} AS price FROM lineitem),
    a AS (SELECT {sql_cents('l_extendedprice')} AS price, l_returnflag, l_partkey, l_linenumber, l_orderkey FROM lineitem),
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, price FROM a),
    t AS (SELECT NOT EXISTS (SELECT * FROM e EXCEPT SELECT * FROM p) AND NOT EXISTS (SELECT * FROM p EXCEPT SELECT * FROM e) AS equal)
    SELECT 'lineitem' AS case_id, CAST(equal AS INTEGER) AS res, CASE WHEN equal THEN 'projection' ELSE 'none' END AS level,
        (SELECT count(*) FROM e) + (SELECT count(*) FROM a) AS diff_rows, CAST(NULL AS VARCHAR) AS error FROM t""",
)
def verdicts_lenient_one_case(spark, sf_dir):
    """All of lineitem as one case that only the projection level decides."""
    lines = table(spark, sf_dir, "lineitem").withColumn("case_key", F.lit("lineitem"))
    rows = results.rows_from_frame(lines, "case_key", "expected", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "lenient").union(
        results.rows_from_frame(lines, "case_key", "actual", ["l_extendedprice", "l_returnflag", "l_partkey", "l_linenumber", "l_orderkey"], "lenient")
    )
    rows = materialise(rows, "case-rows")
    return parity.verdicts(rows, results.sides_of(rows), "lenient")


@query(
    "verdicts_undeclared",
    """SELECT o_orderpriority AS case_id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS res,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'multiset' ELSE 'none' END AS level, CAST(0 AS BIGINT) AS diff_rows,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN 'actual side absent' END AS error
    FROM orders GROUP BY o_orderpriority""",
)
def verdicts_undeclared(spark, sf_dir):
    """Cases with equal rows, of which one alone has side records."""
    orders = table(spark, sf_dir, "orders")
    of = lambda side: results.rows_from_frame(orders, "o_orderpriority", side, ["o_orderkey", "o_totalprice"])
    rows = of("expected").union(of("actual"))
    return parity.verdicts(rows, results.sides_of(rows).filter("case_id = '1-URGENT'"))
