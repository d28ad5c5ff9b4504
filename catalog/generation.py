"""Corpus preparation, prompts, stages and the three-phase run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.texts import ANSWER, CATEGORIES, JSON_OF, duck_expr, spark_expr
from concord.functions import records
from concord.operators import cards as C
from concord.operators import corpus as Q
from concord.operators import ledger, metrics, stage
from concord.plans import generate
from concord.session import materialise, scratch_path
from concord.sources import sinks, tables

# Turns of conversations in the role of questions.
_CORPUS = """conv_id * 1000 + turn AS question_id, text AS question, role AS db_id,
    CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN NULL ELSE concat('turn ', CAST(turn AS {text})) END AS evidence,
    CASE WHEN role = 'user' THEN concat('conversation ', CAST(conv_id AS {text})) END AS verified_knowledge,
    CASE WHEN turn % 3 = 0 THEN concat('SELECT ', CAST(turn AS {text})) END AS gold_sql_a,
    CASE WHEN turn % 3 = 1 THEN concat('["SELECT ', CAST(conv_id AS {text}), '", "other"]') WHEN turn = 3 THEN 'not used' ELSE '' END AS gold_sql_b,
    CASE WHEN role = 'user' THEN 'result = 1' END AS gold_code, role AS difficulty"""


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_split(_CORPUS.format(text="STRING")))


def _split(items: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, quoted, current = [], 0, False, ""
    for ch in items:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0 and not quoted:
            out.append(current)
            current = ""
        else:
            current += ch
    return out + [current]


CORPUS_CTE = f"corpus AS (SELECT {_CORPUS.format(text='VARCHAR')} FROM conversations)"
_PLAIN = "concat(coalesce(evidence, ''), coalesce(verified_knowledge, ''))"
_GOLD = "coalesce(nullif(gold_sql_a, ''), CASE WHEN gold_sql_b LIKE '[%]' THEN json_extract_string(gold_sql_b, '$[0]') ELSE nullif(gold_sql_b, '') END)"


@query(
    "corpus_flat",
    f"""WITH {CORPUS_CTE} SELECT question_id, question, db_id, concat('db/', db_id, '/', db_id, '.sqlite') AS db_path, {_PLAIN} AS knowledge,
    {_GOLD} AS gold_sql, gold_code, difficulty FROM corpus""",
)
def corpus_flat(spark, sf_dir):
    return Q.normalise_corpus(corpus(spark, sf_dir), "db/", gold=("gold_sql_a", "gold_sql_b")).drop("output")


@query("knowledge_plain", f"WITH {CORPUS_CTE} SELECT question_id, {_PLAIN} AS knowledge FROM corpus")
def knowledge_plain(spark, sf_dir):
    return corpus(spark, sf_dir).select(
        "question_id", records.merge_knowledge(F.col("evidence"), F.col("verified_knowledge")).alias("knowledge")
    )


@query(
    "knowledge_labelled",
    f"""WITH {CORPUS_CTE} SELECT question_id, concat_ws(' | ', 'Evidence: ' || nullif(evidence, ''),
    'Verified Knowledge: ' || nullif(verified_knowledge, '')) AS knowledge FROM corpus""",
)
def knowledge_labelled(spark, sf_dir):
    merged = records.merge_knowledge(F.col("evidence"), F.col("verified_knowledge"), "labelled")
    return corpus(spark, sf_dir).select("question_id", merged.alias("knowledge"))


@query("first_nonempty", f"WITH {CORPUS_CTE} SELECT question_id, {_GOLD} AS gold FROM corpus")
def first_nonempty(spark, sf_dir):
    gold = records.first_nonempty([F.col("gold_sql_a"), F.col("gold_sql_b")])
    return corpus(spark, sf_dir).select("question_id", gold.alias("gold"))


@query(
    "wire_roundtrip",
    f"""WITH {CORPUS_CTE} SELECT question_id, concat(question, chr(9), '-----', chr(9), db_id) AS wire, question AS sql, db_id,
    db_id AS path_db FROM corpus""",
)
def wire_roundtrip(spark, sf_dir):
    wired = corpus(spark, sf_dir).select(
        "question_id", records.encode_prediction(F.col("question"), F.col("db_id")).alias("wire"),
        records.database_path(F.col("db_id"), "root/").alias("path"),
    )
    decoded = records.decode_prediction(F.col("wire"))
    return wired.select(
        "question_id", "wire", decoded["sql"].alias("sql"), decoded["db_id"].alias("db_id"),
        records.database_of(F.col("path")).alias("path_db"),
    )


_STATEMENT = """CASE turn % 5 WHEN 0 THEN concat('select ', role) WHEN 1 THEN concat('count(*) FROM ', role)
    WHEN 2 THEN '' WHEN 3 THEN concat('With q AS (SELECT 1) SELECT * FROM ', role) ELSE text END"""


@query(
    "select_prefix",
    f"""WITH s AS (SELECT conv_id, turn, {_STATEMENT} AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN s <> '' AND NOT starts_with(upper(s), 'SELECT') AND NOT regexp_matches(s, '(?i)^with\\s')
        THEN 'SELECT ' || s ELSE s END AS sql,
    CASE WHEN s <> '' AND NOT starts_with(upper(s), 'SELECT') THEN 'SELECT ' || s ELSE s END AS compat_sql FROM s""",
)
def select_prefix(spark, sf_dir):
    s = F.expr(_STATEMENT)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", records.ensure_select_prefix(s).alias("sql"),
        records.ensure_select_prefix(s, strict_compat=True).alias("compat_sql"),
    )


@query(
    "case_id_fill",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 10 END AS question_id,
        CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT o_orderkey, CAST(coalesce(question_id, idx, pos) AS BIGINT) AS case_id FROM o""",
)
def case_id_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 10 END AS question_id",
        "CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS idx",
    )
    return Q.assign_case_id(orders, ["o_orderkey"]).select("o_orderkey", "case_id")


@query("first_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1534")
def first_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return Q.take_first(orders, 1534, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# --- cards and prompts -----------------------------------------------------------------------


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'shop' AS db_id, '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({e}) AS n_null, "
        f"count(DISTINCT {e}) AS n_distinct, CAST(min({e}) AS VARCHAR) AS min_text, CAST(max({e}) AS VARCHAR) AS max_text FROM {name}"
        for c, e in columns
    )


@query(
    "column_profile",
    _profile_sql("customer", [(c, c) for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")] + [("c_nationkey", "nullif(c_nationkey, 3)")])
    + " UNION ALL " + _profile_sql("part", [(c, c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]),
)
def column_profile(spark, sf_dir):
    shop = {
        "customer": table(spark, sf_dir, "customer").withColumn("c_nationkey", F.expr("nullif(c_nationkey, 3)")),
        "part": table(spark, sf_dir, "part"),
        "sqlite_sequence": table(spark, sf_dir, "region"),
    }
    return C.profile_tables(shop, "shop", distinct="exact")


@query(
    "sample_card",
    """WITH first AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, c_name AS b, coalesce(CAST(nullif(c_nationkey, 0) AS VARCHAR), 'None') AS c
        FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12),
    w AS (SELECT CAST(greatest(9, max(length(a))) AS INTEGER) AS wa, CAST(greatest(6, max(length(b))) AS INTEGER) AS wb, CAST(greatest(11, max(length(c))) AS INTEGER) AS wc FROM first),
    lines AS (SELECT 0 AS o, 0.0 AS bal, 0 AS k, lpad('c_custkey', wa, ' ') || ' ' || lpad('c_name', wb, ' ') || ' ' || lpad('c_nationkey', wc, ' ') || ' ' AS line FROM w
        UNION ALL SELECT 1, -customer.c_acctbal, first.c_custkey, lpad(a, wa, ' ') || ' ' || lpad(b, wb, ' ') || ' ' || lpad(c, wc, ' ') || ' ' FROM first, w, customer
        WHERE customer.c_custkey = first.c_custkey)
    SELECT string_agg(line, chr(10) ORDER BY o, bal, k) AS card FROM lines""",
)
def sample_card(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    frame = customer.select("c_custkey", "c_name", F.expr("nullif(c_nationkey, 0)").alias("c_nationkey"), (-F.col("c_acctbal")).alias("o"))
    return C.sample_text(frame, 12, ["o", "c_custkey"], ["c_custkey", "c_name", "c_nationkey"])


_CARDS = "cards AS (SELECT * FROM (VALUES ('user', 'TABLE u'), ('assistant', 'TABLE a')) AS t(db_id, card))"


def _cards(spark) -> DataFrame:
    return spark.createDataFrame([("user", "TABLE u"), ("assistant", "TABLE a")], "db_id string, card string")


TEMPLATE = [
    C.Part("card", suffix="\n\n"), C.Part("knowledge", prefix="-- Known: ", suffix="\n"),
    C.Part("knowledge", replace="-- Answer with the knowledge.\n", otherwise="-- Answer.\n"),
    C.text("-- "), C.Part("question"), C.text("\nSELECT "),
]
_PROMPT = """concat(CASE WHEN coalesce(card, '') <> '' THEN card || chr(10) || chr(10) ELSE '' END,
    CASE WHEN knowledge <> '' THEN '-- Known: ' || knowledge || chr(10) || '-- Answer with the knowledge.' || chr(10) ELSE '-- Answer.' || chr(10) END,
    '-- ', question, chr(10), 'SELECT ')"""


@query(
    "prompt_build",
    f"""WITH {CORPUS_CTE}, {_CARDS}, flat AS (SELECT question_id, db_id, question, {_PLAIN} AS knowledge FROM corpus)
    SELECT question_id, db_id, {_PROMPT} AS prompt FROM flat LEFT JOIN cards USING (db_id)""",
)
def prompt_build(spark, sf_dir):
    return C.build_prompts(corpus_flat(spark, sf_dir), _cards(spark), TEMPLATE)


def _card_sql(name: str, columns: list[tuple[str, str]], order: str, n: int) -> str:
    """The definition of a table and its first rows as the card has them."""
    ddl = f"concat('CREATE TABLE {name} (', chr(10), " + ", ',', chr(10), ".join(f"'  {c} {t}'" for c, t in columns) + ", chr(10), ')')"
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None') AS {c}" for c, _ in columns)
    wide = lambda c: f"CAST(greatest({len(c)}, (SELECT max(length({c})) FROM {name}_rows)) AS INTEGER)"
    head = " || ' ' || ".join(f"lpad('{c}', {wide(c)}, ' ')" for c, _ in columns)
    line = " || ' ' || ".join(f"lpad({c}, {wide(c)}, ' ')" for c, _ in columns)
    return f"""{name}_rows AS (SELECT row_number() OVER (ORDER BY {order}) AS nr, {texts} FROM {name} ORDER BY {order} LIMIT {n}),
    {name}_card AS (SELECT concat({ddl}, ' ', chr(10), ' /* ', chr(10), ' {n} example rows: ', chr(10), ' SELECT * FROM {name} LIMIT {n}; ', chr(10), ' ',
        {head} || ' ', chr(10), (SELECT string_agg({line} || ' ', chr(10) ORDER BY nr) FROM {name}_rows), ' ', chr(10), ' */') AS card)"""


_SHOP = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string")],
}
_SHOP_ORDER = {"customer": ["c_custkey"], "part": ["p_partkey"], "conversations": ["conv_id", "turn"]}


@query(
    "schema_card",
    "WITH " + ", ".join(_card_sql(n, c, ", ".join(f"{n}.{k}" for k in _SHOP_ORDER[n]), 7) for n, c in _SHOP.items())
    + " SELECT 'shop' AS db_id, concat_ws(chr(10) || chr(10), " + ", ".join(f"(SELECT card FROM {n}_card)" for n in _SHOP) + ") AS card",
)
def schema_card(spark, sf_dir):
    """Definitions and first rows of the tables of a database."""
    shop = {n: table(spark, sf_dir, n).select(*[name for name, _ in c]) for n, c in _SHOP.items()}
    return C.schema_cards(spark, {"shop": shop}, sample_rows=7, order=_SHOP_ORDER)


# --- stages ------------------------------------------------------------------------------------


def _shout(prompt: str):
    """A stand-in model: fails on some prompts, else answers in upper case."""
    if len(prompt) % 7 == 0:
        raise ConnectionError("connection reset by peer")
    if len(prompt) % 7 == 1:
        raise ValueError("cannot answer")
    return f"```sql\n{len(prompt)}\n```", f"saw {len(prompt)} characters"


@query(
    "stage_run",
    f"""WITH {CORPUS_CTE}, n AS (SELECT question_id, length(question) AS n FROM corpus)
    SELECT question_id, CASE WHEN n % 7 > 1 THEN concat('```sql', chr(10), n, chr(10), '```') END AS response,
    CASE WHEN n % 7 > 1 THEN concat('saw ', n, ' characters') END AS reasoning,
    CASE n % 7 WHEN 0 THEN 'transient' WHEN 1 THEN 'permanent' ELSE 'ok' END AS status,
    CASE n % 7 WHEN 0 THEN 'connection reset by peer' WHEN 1 THEN 'cannot answer' END AS error FROM n""",
)
def stage_run(spark, sf_dir):
    prompts = corpus(spark, sf_dir).select("question_id", F.col("question").alias("prompt"))
    return stage.run_stage(prompts, _shout).drop("prompt")


def _ask(prompt: str) -> str:
    return f"question of {len(prompt)}"


def _tell(prompt: str) -> str:
    return '{"classification": ["Scope"], "answer": "note %d"}' % (len(prompt) % 10)


def _solve(prompt: str) -> str:
    return f"```sql\nSELECT {len(prompt)};\n```"


PHASE_TEMPLATES = {
    "probe": [C.Part("card", suffix="\n"), C.Part("question")],
    "oracle": [C.Part("inquiry", suffix="\n"), C.Part("gold_sql", prefix="gold: ")],
    "final": [C.Part("knowledge", suffix="\n"), C.Part("question")],
}
_THREE = f"""{CORPUS_CTE}, {_CARDS}, flat AS (SELECT question_id, db_id, question, {_PLAIN} AS knowledge, {_GOLD} AS gold_sql FROM corpus),
    p AS (SELECT flat.*, concat('question of ', length(question) + CASE WHEN card IS NULL THEN 0 ELSE 8 END) AS inquiry FROM flat LEFT JOIN cards USING (db_id)),
    o AS (SELECT *, (length(inquiry) + 1 + coalesce(6 + length(gold_sql), 0)) % 10 AS n FROM p),
    t AS (SELECT *, concat('note ', n) AS answer, length(knowledge || ' Note: note ' || n) + 1 + length(question) AS m FROM o)"""


def _three_phase(spark, sf_dir, path):
    return generate.three_phase(corpus_flat(spark, sf_dir), _cards(spark), _ask_or_solve, _tell, PHASE_TEMPLATES, path)


def _ask_or_solve(prompt: str) -> str:
    return _solve(prompt) if "Note: note" in prompt else _ask(prompt)


@query("three_phase_final", f"WITH {_THREE} SELECT question_id, concat('SELECT ', m) AS final, 'ok' AS status FROM t")
def three_phase_final(spark, sf_dir):
    final, _ = _three_phase(spark, sf_dir, scratch_path(spark, "phases"))
    return final.select("question_id", "final", "status")


@query(
    "full_log",
    f"""WITH {_THREE} SELECT question_id, question, coalesce(gold_sql, '') AS gold, inquiry, answer, 'Scope' AS categories,
    concat('SELECT ', m) AS final FROM t""",
)
def full_log(spark, sf_dir):
    final, phases = _three_phase(spark, sf_dir, scratch_path(spark, "phases"))
    log = metrics.full_log(corpus_flat(spark, sf_dir), phases, final)
    return log.withColumn("categories", F.array_join("categories", "|"))


@query(
    "phase_log_roundtrip",
    f"WITH {CORPUS_CTE} SELECT question_id, question AS prompt, concat('to ', db_id) AS response, difficulty AS phase FROM corpus",
)
def phase_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "phase-log")
    sinks.write_phase_log(
        corpus(spark, sf_dir).select(
            "question_id", F.col("question").alias("prompt"), F.concat(F.lit("to "), "db_id").alias("response"),
            F.col("difficulty").alias("phase"),
        ),
        path,
    )
    return spark.read.parquet(path)


@query(
    "prediction_roundtrip",
    f"""WITH {CORPUS_CTE} SELECT question_id, db_id, question AS sql, concat(question, chr(9), '-----', chr(9), db_id) AS wire FROM corpus""",
)
def prediction_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(corpus(spark, sf_dir).withColumnRenamed("question", "sql"), path, "sql")
    good, _ = tables.read_ledger(spark, path, "question_id bigint, db_id string, sql string, wire string")
    return good


@query(
    "corpus_read",
    f"""WITH {CORPUS_CTE} SELECT question_id, db_id, question, evidence, verified_knowledge, difficulty,
    concat('SELECT ', question_id) AS gold_sql, concat('[[', question_id, ',"', db_id, '"]]') AS output FROM corpus""",
)
def corpus_read(spark, sf_dir):
    """Records whose gold field differs by case and by type, written as JSON lines and read back."""
    path = scratch_path(spark, "corpus")
    sql = F.concat(F.lit("SELECT "), F.col("question_id"))
    user = F.col("db_id") == "user"
    frame = corpus(spark, sf_dir).select(
        "question_id", "db_id", "question", "evidence", "verified_knowledge", "difficulty",
        F.when(~user, sql).alias("query"), F.when(user, F.array(sql, F.lit("x"))).alias("SQL"),
        F.array(F.array(F.col("question_id").cast("variant"), F.col("db_id").cast("variant"))).alias("output"),
    )
    frame.write.json(path)
    return tables.read_corpus(spark, path, lines=True).drop("pos", "idx", "gold_code")


@query(
    "corpus_read_array",
    f"""WITH {CORPUS_CTE} SELECT question_id, db_id, question, evidence, verified_knowledge, difficulty,
    concat('SELECT ', question_id) AS gold_sql, concat('[[', question_id, ']]') AS output FROM corpus""",
)
def corpus_read_array(spark, sf_dir):
    """The same records as JSON arrays, one file for each of some hundred conversations."""
    path = scratch_path(spark, "corpus")
    fields = ("question_id", "db_id", "question", "evidence", "verified_knowledge", "difficulty")
    sql = F.array(F.concat(F.lit("SELECT "), F.col("question_id"))).alias("SQL")
    record = F.to_json(F.struct(*fields, sql, F.array(F.array("question_id")).alias("output")))
    frame = corpus(spark, sf_dir).select(F.floor(F.col("question_id") / 100_000).alias("part"), record.alias("r"))
    arrays = frame.groupBy("part").agg(F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list("r")), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return tables.read_corpus(spark, path).drop("pos", "idx", "gold_code")
