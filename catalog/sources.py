"""Reading and writing tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from concord.operators.cards import key_report as report_keys
from concord.plans.export import export_database
from concord.session import scratch_path
from concord.sources import sinks, tables


@query(
    "table_dir_roundtrip",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name, 'customer:UTF-8:ok,nation:UTF-8:ok' AS status
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def table_dir_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "export")
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    export_database(spark, frames, path, {"customer": ["c_custkey"], "nation": ["n_nationkey"]})
    read, status = tables.read_table_dir(spark, path, {n: df.schema for n, df in frames.items()})
    seen = status.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "table_name", "encoding", "status"))), ",").alias("status"))
    note = seen.first()["status"]
    return (
        read["customer"].join(read["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name", F.lit(note).alias("status"))
    )


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_FLOATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "export_float_text",
    "SELECT " + ", ".join(f"printf('%.10f', {c}) AS {c}" if c in _FLOATS else f"strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000') AS {c}" if c == "l_shipdate" else
                          f"CAST({c} AS VARCHAR) AS {c}" for c in _LINE) + " FROM lineitem",
)
def export_float_text(spark, sf_dir):
    """All of lineitem through the export, as the text that its files hold."""
    path = scratch_path(spark, "export-lines")
    sinks.export_table(table(spark, sf_dir, "lineitem").select(*_LINE), path, ["l_orderkey", "l_linenumber", "l_partkey"])
    return spark.read.option("header", True).option("escape", '"').csv(path).select(*_LINE)


_KEYS = (("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ("tax_code",))


@query(
    "key_report",
    "WITH l AS (SELECT *, nullif(l_tax, 0) AS tax_code FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{','.join(k)}' AS key, count(*) AS n_rows, count(DISTINCT ({', '.join(k)},)) FILTER ({' AND '.join(c + ' IS NOT NULL' for c in k)}) AS n_distinct, "
        f"count(*) FILTER ({' OR '.join(c + ' IS NULL' for c in k)}) AS n_null, "
        f"CAST(count(*) = count(DISTINCT ({', '.join(k)},)) FILTER ({' AND '.join(c + ' IS NOT NULL' for c in k)}) AS INTEGER) AS is_key FROM l"
        for k in _KEYS
    ),
)
def key_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("tax_code", F.expr("nullif(l_tax, 0)"))
    return report_keys(lines, _KEYS)


@query("table_dir_gbk", "SELECT c_custkey, concat(c_name, ' 客户') AS c_name, 'GBK:ok' AS status FROM customer")
def table_dir_gbk(spark, sf_dir):
    """A table in another encoding, found by its bytes; no setting of the session stays changed."""
    path, setting = scratch_path(spark, "gbk"), "spark.sql.legacy.javaCharsets"
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" 客户")).alias("c_name"))
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        named.write.option("header", True).option("encoding", "GBK").csv(f"{path}/customer.csv")
    finally:
        spark.conf.set(setting, before)
    read, status = tables.read_table_dir(spark, path, {"customer": named.schema})
    note = status.select(F.concat_ws(":", "encoding", "status").alias("status")).first()["status"]
    return read["customer"].withColumn("status", F.lit(note))
