"""Deduplication, ledgers, accuracy and streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from concord.operators import ledger, metrics
from concord.operators.cases import Case
from concord.plans import evaluate
from concord.session import scratch_path
from concord.sources import sinks, tables
from concord.streaming.verdicts import stream_accuracy, stream_verdicts, unread_path


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


_ONE = "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {d}) = 1"


@query("keep_first", _ONE.format(d=""))
def keep_first(spark, sf_dir):
    return ledger.keep_first(_orders(spark, sf_dir), "o_custkey", "o_orderkey")


@query(
    "latest_entry",
    "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def latest_entry(spark, sf_dir):
    return ledger.latest_entry(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query(
    "dup_report",
    "SELECT o_custkey, count(*) AS n, count(*) - 1 AS n_dropped FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def dup_report(spark, sf_dir):
    return ledger.duplicate_report(table(spark, sf_dir, "orders"), "o_custkey")


@query("pending_anti", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return ledger.pending(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(
    "ledger_new_rows",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def ledger_new_rows(spark, sf_dir):
    held = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    batch = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice")
    return ledger.new_rows(batch, held, "o_custkey", "o_orderkey")


@query(
    "ledger_append",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""",
)
def ledger_append(spark, sf_dir):
    """Two batches, the second repeated: ids already held stay as they were."""
    path = scratch_path(spark, "ledger")
    orders = _orders(spark, sf_dir)
    ledger.append_new(orders.filter("o_orderstatus = 'F'"), path, "o_custkey", "o_orderkey")
    for _ in range(2):
        ledger.append_new(orders.filter("o_orderstatus <> 'F'"), path, "o_custkey", "o_orderkey")
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "ledger_two_writers",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""",
)
def ledger_two_writers(spark, sf_dir):
    """Two writers with overlapping ids that do not see each other, each of them repeated: one row an id."""
    path, orders = scratch_path(spark, "ledger"), _orders(spark, sf_dir)
    batches = {"1": orders.filter("o_orderstatus = 'F'"), "2": orders.filter("o_orderstatus = 'O'")}
    blind = scratch_path(spark, "ledger")
    for name in ("2", "1"):  # each writes to a ledger where it sees only itself
        ledger.append_batch(batches[name], f"{blind}-{name}", name, "o_custkey", "o_orderkey")
        spark.read.parquet(f"{blind}-{name}").write.mode("append").partitionBy("batch").parquet(path)
    for name in ("1", "2", "2"):
        ledger.append_batch(batches[name], path, name, "o_custkey", "o_orderkey")
    return ledger.read_batches(spark, path, orders.schema, "o_custkey")


@query(
    "attach_expected",
    """WITH gold AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS output FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT c_custkey AS question_id, c_name, output, CASE WHEN output IS NULL THEN 'missing' ELSE 'ok' END AS status
    FROM customer LEFT JOIN gold ON c_custkey = o_custkey""",
)
def attach_expected(spark, sf_dir):
    preds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), "c_name")
    gold = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("output"),
    )
    return ledger.attach_expected(preds, gold)


@query("verdicts_sorted", "SELECT doc_id AS case_id, quality AS res FROM labels ORDER BY case_id")
def verdicts_sorted(spark, sf_dir):
    return ledger.order_by_case(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("res")))


# Languages in the role of strata: one language is not listed, one listed level is empty.
_LEVELS = ("en", "fr", "de", "none such")
_ACCURACY = """v AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)),
    levels AS (SELECT * FROM (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'none such')) AS t(pos, level)),
    counted AS (SELECT pos, level, count(quality) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS n_correct
        FROM levels LEFT JOIN v ON lang = level GROUP BY ALL),
    total AS (SELECT * FROM counted UNION ALL SELECT 4, 'total', CAST(sum(n) AS BIGINT), CAST(sum(n_correct) AS BIGINT) FROM counted),
    acc AS (SELECT *, CASE WHEN n > 0 THEN n_correct / n * 100 ELSE 0.0::DOUBLE END AS accuracy FROM total)"""


def _accuracy(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("res"))
    strata = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("difficulty"))
    return metrics.accuracy(verdicts, strata, levels=_LEVELS)


@query("accuracy_rollup", f"WITH {_ACCURACY} SELECT * FROM acc")
def accuracy_rollup(spark, sf_dir):
    return _accuracy(spark, sf_dir)


@query(
    "accuracy_report",
    f"WITH {_ACCURACY} SELECT pos, printf('%-12s: %d/%d correct, accuracy = %.4f%%', level, n_correct, n, accuracy) AS line FROM acc ORDER BY pos",
)
def accuracy_report(spark, sf_dir):
    return metrics.accuracy_report(_accuracy(spark, sf_dir))


@query(
    "event_log_counts",
    "SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'COMPARISON_INFO' END AS type, count(*) AS n FROM events GROUP BY 1",
)
def event_log_counts(spark, sf_dir):
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select(
        "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("COMPARISON_INFO").alias("type"),
        F.col("event_id").cast("string").alias("case_id"), F.col("props").alias("message"),
    )
    sinks.event_log(events, path)
    return sinks.event_counts(spark.read.parquet(path))


@query(
    "ledger_read",
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'good' AS line FROM events WHERE event_type <> 'error'
    UNION ALL SELECT NULL, NULL, NULL, concat('{"event_id": ', event_id, ', broken') FROM events WHERE event_type = 'error'""",
)
def ledger_read(spark, sf_dir):
    """JSON lines among blank and malformed ones."""
    path = scratch_path(spark, "lines")
    events = table(spark, sf_dir, "events")
    good = F.concat(
        F.lit('{"event_id": '), F.col("event_id"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('", "k": '),
        F.get_json_object("props", "$.k"), F.lit("}"),
    )
    bad = F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(", broken"))
    lines = events.select(F.when(F.col("event_type") == "error", F.concat_ws("\n", F.lit("  "), bad)).otherwise(good).alias("value"))
    lines.write.text(path)
    kept, broken = tables.read_ledger(spark, path, "event_id bigint, event_type string, k bigint")
    return kept.withColumn("line", F.lit("good")).unionByName(broken, allowMissingColumns=True)


@query(
    "stream_ledger",
    """SELECT o_custkey AS case_id, CAST(o_orderstatus = 'F' AS INTEGER) AS res, o_orderkey AS seq FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def stream_ledger(spark, sf_dir):
    """Orders as a stream of verdicts, run to its end and started a second time."""
    root = scratch_path(spark, "stream")
    lines = table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(
            F.col("o_custkey").alias("case_id"), (F.col("o_orderstatus") == "F").cast("int").alias("res"),
            F.col("o_orderkey").alias("seq"),
        )).alias("value")
    )
    lines.write.text(f"{root}/in")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{root}/in")
    for _ in range(2):
        stream_verdicts(spark, f"{root}/in", f"{root}/ledger", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("case_id bigint, res int, seq bigint").parquet(f"{root}/ledger")


@query(
    "stream_accuracy",
    """SELECT event_type AS level, count(*) AS n, CAST(count(*) FILTER (value > 50) AS BIGINT) AS n_correct FROM events GROUP BY event_type""",
)
def stream_accuracy_of_events(spark, sf_dir):
    """Events as verdicts in several micro-batches, some late and a third of them sent again; stopped and started between."""
    root = scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("case_id"), (F.col("value") > 50).cast("int").alias("res"), F.col("event_type").alias("level"), F.col("ts").cast("string").alias("ts"),
    )
    part = F.pmod(F.xxhash64("case_id"), F.lit(4))
    for i in range(4):
        again = events.filter((part == i - 1) & (F.col("case_id") % 3 == 0)) if i else events.limit(0)
        lines = events.filter(part == i).unionByName(again).select(F.to_json(F.struct("*")).alias("value"))
        lines.coalesce(2).write.mode("append").text(f"{root}/in")
        stream_accuracy(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", delay="3650 days", files=1).awaitTermination()
    return metrics.totals(spark.read.parquet(f"{root}/out/totals"))


@query(
    "evaluate_run",
    """WITH first AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    v AS (SELECT c_custkey, c_mktsegment AS level, CAST(o_orderstatus <> 'P' AS INTEGER) AS res FROM customer JOIN first ON c_custkey = o_custkey)
    SELECT level, count(*) AS n, CAST(sum(res) AS BIGINT) AS n_correct FROM v GROUP BY level
    UNION ALL SELECT 'total', count(*), CAST(sum(res) AS BIGINT) FROM v""",
)
def evaluate_run(spark, sf_dir):
    """Predictions and expected outputs as JSON, through verdicts and ledger to accuracy."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = ledger.keep_first(orders, "o_custkey", "o_orderkey")
    as_json = lambda price: F.to_json(F.array(F.struct(F.col("o_orderkey").alias("k"), price.alias("p"))))
    preds = orders.select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pos"),
        as_json(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).alias("output"),
    )
    corpus = first.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pos"),
        F.col("c_mktsegment").alias("difficulty"), as_json(F.col("o_totalprice")).alias("output"),
    )
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    _, acc = evaluate.evaluate(preds, corpus, scratch_path(spark, "verdict-ledger"), levels=segments)
    return acc.select("level", "n", "n_correct")


@query("records_without_order", "SELECT doc_id, lang, source FROM documents")
def records_without_order(spark, sf_dir):
    """One record an id; those in English have no order, and keep their fields all the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("nullif(lang, 'en')").alias("o"))
    return ledger.keep_first(docs, "doc_id", "o").drop("o")


@query(
    "stream_unread",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN concat('{"case_id": ', o_custkey, ', broken ', o_orderkey)
        ELSE concat('{"res":1,"seq":', o_orderkey, '}') END AS line FROM orders WHERE o_orderstatus <> 'F'""",
)
def stream_unread(spark, sf_dir):
    """Lines of a verdict stream that do not parse or have no id, the stream started twice."""
    root = scratch_path(spark, "stream")
    status, key = F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    good = F.to_json(F.struct(key.alias("case_id"), F.lit(1).alias("res"), F.col("o_orderkey").alias("seq")))
    broken = F.concat(F.lit('{"case_id": '), F.col("o_custkey"), F.lit(", broken "), F.col("o_orderkey"))
    table(spark, sf_dir, "orders").select(F.when(status == "P", broken).otherwise(good).alias("value")).write.text(f"{root}/in")
    for _ in range(2):
        stream_verdicts(spark, f"{root}/in", f"{root}/ledger", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(unread_path(f"{root}/ledger")).select("line")


@query(
    "evaluate_cases",
    """WITH r AS (SELECT 'simple' AS level, 1 AS ok UNION ALL
        SELECT 'moderate', CAST(NOT EXISTS (SELECT n_name FROM nation WHERE n_nationkey <= 0) AS INTEGER) UNION ALL
        SELECT 'challenging', CAST(NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS INTEGER) UNION ALL
        SELECT 'challenging', 0),
    a AS (SELECT level, count(*) AS n, CAST(sum(ok) AS BIGINT) AS n_correct FROM r GROUP BY level
        UNION ALL SELECT 'total', count(*), CAST(sum(ok) AS BIGINT) FROM r)
    SELECT *, 4 AS n_verdicts, 1 AS n_events FROM a""",
)
def evaluate_cases(spark, sf_dir):
    """Cases to accuracy, run twice; one case reads a table that only the other database has, and must fail."""
    tables_ = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "nation", "region")}
    databases = {"shop": tables_, "geo": {n: tables_[n] for n in ("nation", "region")}}
    cases = [
        Case("segments", "shop", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", lambda t: t["customer"].groupBy("c_mktsegment").count()),
        Case("wrong filter", "geo", "SELECT n_name FROM nation", lambda t: t["nation"].filter("n_nationkey > 0").select("n_name")),
        Case("customers with a nation", "shop", "SELECT c_custkey FROM customer",
             lambda t: t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")),
        Case("foreign table", "geo", "SELECT count(*) FROM nation", "SELECT count(*) FROM orders"),
    ]
    level = dict(zip((c.case_id for c in cases), ("simple", "moderate", "challenging", "challenging")))
    strata = spark.createDataFrame(list(level.items()), "case_id string, difficulty string")
    path = scratch_path(spark, "evaluation")
    for _ in range(2):
        verdicts, acc = evaluate.evaluate_cases(spark, cases, databases, strata, path)
    events = spark.read.parquet(f"{path}/events").count()
    return acc.select("level", "n", "n_correct", F.lit(verdicts.count()).cast("int").alias("n_verdicts"), F.lit(events).cast("int").alias("n_events"))
