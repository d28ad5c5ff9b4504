"""Sources, sinks, stages, ledgers and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from concord.operators import cards, cases, corpus, ledger, metrics, parity, results, stage
from concord.plans import evaluate, generate
from concord.sources import sinks, tables
from concord.streaming.verdicts import stream_accuracy, stream_verdicts, unread_path


def test_table_dir(spark, tmp_path):
    (tmp_path / "plain.csv").write_bytes("﻿a,b\n1,x\n2,\"y \"\"q\"\"\nz\"\n".encode())
    (tmp_path / "Wide.CSV").write_bytes("a,b\n1,中文\n".encode("gbk"))
    (tmp_path / "notes.txt").write_text("no table")
    read, status = tables.read_table_dir(spark, str(tmp_path), {"plain": "a int, b string"})
    assert set(read) == {"plain", "Wide"}
    assert [tuple(r) for r in read["plain"].collect()] == [(1, "x"), (2, 'y "q"\nz')]
    assert read["Wide"].first()["b"] == "中文"
    assert {(r.table_name, r.encoding) for r in status.collect()} == {("plain", "UTF-8"), ("Wide", "GBK")}


def test_table_dir_splits_files_and_leaves_no_setting(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f'{i},"v ""{i}"""\n' for i in range(40_000)))
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "wide.csv").write_bytes("a,b\n1,中文\n".encode("gbk"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read, _ = tables.read_table_dir(spark, str(tmp_path), {"big": "a int, b string"})
        assert read["big"].rdd.getNumPartitions() > 3
        assert read["big"].agg(F.sum("a"), F.min("b")).first() == (sum(range(40_000)), 'v "0"')
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read["wide"].first()["b"] == "中文" and read["empty"].count() == 0
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_large_array_corpus_loses_nothing(spark, tmp_path):
    """Beyond the size of one variant (128 MB)."""
    n, pad = 150_000, "x" * 960
    with (tmp_path / "c.json").open("w") as f:
        f.write("[" + ",\n".join(f'{{"question_id": {i}, "question": "{pad}", "SQL": ["s{i}"]}}' for i in range(n)) + "]")
    got = tables.read_corpus(spark, str(tmp_path / "c.json"))
    row = got.agg(F.count("*"), F.sum("question_id"), F.max("pos"), F.count("gold_sql"), F.min(F.length("question"))).first()
    assert tuple(row) == (n, n * (n - 1) // 2, n - 1, n, 960)
    (tmp_path / "cut.json").write_text('[{"question_id": 1}, {"quest')
    with pytest.raises(Exception):
        tables.read_corpus(spark, str(tmp_path / "cut.json")).collect()


def test_records_without_an_order_are_kept(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c"), (2, 7, "d"), (None, None, "e")], "k int, o int, v string")
    assert {(r.k, r.v) for r in ledger.keep_first(df, "k", "o").collect()} == {(1, "a"), (2, "c"), (None, "e")}
    assert {(r.k, r.v) for r in ledger.latest_entry(df, "k", "o").collect()} == {(1, "a"), (2, "d"), (None, "e")}


def test_stream_keeps_what_it_could_not_read(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    (source / "a.json").write_text('{"case_id": 1, "res": 1, "seq": 1}\n{broken\n\n{"res": 0, "seq": 2}\n{"case_id": "x", "res": 1, "seq": 3}\n')
    for _ in range(2):
        stream_verdicts(spark, str(source), path, str(tmp_path / "checkpoint")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(path).select("case_id", "res", "seq").collect()] == [(1, 1, 1)]
    assert sorted(r.line for r in spark.read.parquet(unread_path(path)).collect()) == ['{"case_id": "x", "res": 1, "seq": 3}', '{"res": 0, "seq": 2}', "{broken"]


def test_export_is_ordered_and_keeps_empty_headers(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 3, None if i % 5 else "v") for i in range(100)], "k int, x double, s string")
    sinks.export_table(df.repartition(3), str(tmp_path / "t.csv"), ["k"])
    parts = sorted((tmp_path / "t.csv").glob("part-*.csv"))
    lines = [line for p in parts for line in p.read_text().splitlines() if not line.startswith('"k"')]
    assert [int(line.split(",")[0].strip('"')) for line in lines] == list(range(100))
    assert lines[1].split(",")[1] == '"0.3333333333"'
    sinks.export_table(df.limit(0), str(tmp_path / "e.csv"), ["k"])
    assert any(p.read_text().startswith('"k","x","s"') for p in (tmp_path / "e.csv").glob("part-*.csv"))


def test_corpus_and_ledger_files(spark, tmp_path):
    records = [
        {"question_id": 3, "db_id": "a", "question": "q", "sql": "", "SQL": ["y", "z"], "output": [[1, None]]},
        {"question_id": 4, "db_id": "b", "question": "r", "query": "w", "evidence": 5, "code": ["c1"], "output": None},
    ]
    (tmp_path / "c.json").write_text(json.dumps(records))
    rows = {r.question_id: r for r in tables.read_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert (rows[3].gold_sql, rows[3].output, rows[3].pos) == ("y", "[[1,null]]", 0)
    assert (rows[4].gold_sql, rows[4].gold_code, rows[4].evidence, rows[4].output) == ("w", "c1", "5", None)
    (tmp_path / "one.json").write_text(json.dumps(records[1]))
    assert tables.read_corpus(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "l.jsonl").write_text('{"question_id": 1, "code": "a"}\n\n  \n{broken\n{"question_id": 1, "code": "b"}\n')
    good, bad = tables.read_ledger(spark, str(tmp_path / "l.jsonl"), "question_id bigint, code string")
    assert sorted(r.code for r in good.collect()) == ["a", "b"] and [r.line for r in bad.collect()] == ["{broken"]


def test_positions_are_exact(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = corpus.with_position(df, ["k"]).collect()
    assert all(r.pos == r.k for r in got) and len(got) == 1000


def test_take_first(spark):
    df = spark.range(10)
    assert [r.id for r in corpus.take_first(df, 3, [F.col("id").desc()]).collect()] == [9, 8, 7]
    assert corpus.take_first(df, 0, ["id"]).count() == 10


def test_hot_id_is_combined_before_the_shuffle(spark):
    df = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 7)).alias("k"), "id", F.lit("x").alias("v"))
    got = {r.k: r.id for r in ledger.keep_first(df, "k", "id").collect()}
    want = {}
    for i in range(3000):
        want.setdefault(i % 3 * (i % 7), i)
    assert got == want
    plan = ledger.keep_first(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and plan.index("partial_min_by") > plan.index("Exchange")


def test_stage_resumes_only_what_may_pass(spark, tmp_path):
    path = str(tmp_path / "stage")
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "question_id bigint, prompt string")

    def flaky(prompt):
        if prompt == "p1":
            raise TimeoutError("late")
        if prompt == "p2":
            raise ValueError("bad prompt")
        return prompt.upper(), "why"

    first = {r.question_id: r for r in stage.stage_to_table(prompts, flaky, "final", path).collect()}
    assert (first[1].status, first[2].status, first[3].response, first[3].reasoning) == ("transient", "permanent", "P3", "why")
    assert first[1].response is None and first[2].error == "bad prompt"
    second = {r.question_id: r for r in stage.stage_to_table(prompts, lambda p: "again", "final", path).collect()}
    assert second[1].response == "again" and second[2].status == "permanent" and second[3].response == "P3"


def test_answers_outlive_a_lost_task(spark, tmp_path):
    """The process is gone after 23 calls of a task; a second run asks again for no more than a chunk of each task."""
    path, calls, chunk = str(tmp_path / "stage"), tmp_path / "calls", 5
    calls.mkdir()
    prompts = spark.range(60).selectExpr("id AS question_id", "concat('p', id) AS prompt").coalesce(1)

    def dying(prompt):
        import os

        with open(calls / f"{prompt}-{os.getpid()}-{os.urandom(4).hex()}", "w"):
            pass
        if len(os.listdir(calls)) == 23:
            os._exit(1)
        return prompt.upper()

    with pytest.raises(Exception):
        stage.stage_to_table(prompts, dying, "final", path, chunk=chunk).count()
    got = {r.question_id: r.response for r in stage.stage_to_table(prompts, dying, "final", path, chunk=chunk).collect()}
    assert got == {i: f"P{i}" for i in range(60)}
    asked = [c.name.split("-")[0] for c in calls.iterdir()]
    again = len(asked) - len(set(asked))
    assert len(set(asked)) == 60 and 1 <= again <= chunk
    stage.stage_to_table(prompts, dying, "final", path, chunk=chunk).count()
    assert len(list(calls.iterdir())) == len(asked)


def test_calls_side_by_side_and_again(spark):
    """Four calls at a time; a call that fails once is tried again."""
    import time

    seen = {}

    def slow(prompt):
        time.sleep(0.2)
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "p3" and seen[prompt] < 3:
            raise ConnectionError("reset")
        return prompt

    df = spark.range(16).selectExpr("concat('p', id) AS prompt").coalesce(1)
    start = time.time()
    got = stage.run_stage(df, slow, concurrent=8, retries=2, pause=0.01).collect()
    assert [r.response for r in got] == [f"p{i}" for i in range(16)] and {r.status for r in got} == {"ok"}
    assert time.time() - start < 16 * 0.2 + 5
    assert {r.prompt: r.status for r in stage.run_stage(df, slow, retries=0).collect()}["p3"] == "transient"


def test_two_writers_leave_one_row_an_id(spark, tmp_path):
    """Both look at the ledger before either writes; readers agree, and a batch that is repeated changes nothing."""
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id int, v string")
    two = spark.createDataFrame([(2, "b"), (3, "b"), (4, "b"), (4, "c")], "id int, v string")
    ledger.append_batch(spark.createDataFrame([(9, "z")], "id int, v string"), path, "0", "id", "v")
    held = [ledger._batches(spark, path, one.schema) for _ in range(2)]
    for name, batch, seen in (("2", two, held[1]), ("1", one, held[0])):
        new = ledger.new_rows(batch, seen, "id", "v").withColumn("batch", F.lit(name))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    want = {(9, "z"), (1, "a"), (2, "a"), (3, "a"), (4, "b")}
    assert {tuple(r) for r in ledger.read_batches(spark, path, one.schema, "id").collect()} == want
    for name, batch in (("1", one), ("2", two), ("1", one)):
        ledger.append_batch(batch, path, name, "id", "v")
        assert sorted(tuple(r) for r in ledger.read_batches(spark, path, one.schema, "id").collect()) == sorted(want)


def test_faulty_cases_are_found_by_halves(spark, tmp_path, monkeypatch):
    """64 cases with two that fail when they run: at most 20 writes of results, the other verdicts unchanged."""
    good = [cases.Case(f"c{i:02}", "db", f"SELECT {i} AS x", f"SELECT {i} AS x") for i in range(64)]
    broken = "SELECT raise_error('broken') AS x FROM range(3)"
    sides = [cases.Case(c.case_id, "db", c.expected, broken if c.case_id in ("c10", "c11") else c.actual) for c in good]
    writes = []
    plain = cases.uuid.uuid4
    monkeypatch.setattr(cases.uuid, "uuid4", lambda: writes.append(1) or plain())
    rows, found = cases.run_cases(spark, sides, {"db": {}}, str(tmp_path / "cases"), batch=128)
    got = {r.case_id: r.res for r in parity.verdicts(rows, found).collect()}
    assert got == {c.case_id: int(c.case_id not in ("c10", "c11")) for c in good}
    assert len(writes) <= 22  # a name for each attempt, and Spark's own few


def test_rows_without_a_case_are_kept(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    for profile in ("strict", "lenient"):
        rows = results.rows_from_frame(df, "k", "expected", profile=profile).union(results.rows_from_frame(df.filter("v < 3"), "k", "actual", profile=profile))
        assert rows.count() == 5 and rows.filter("cells IS NULL").count() == 0
        assert results.to_cells(df, "k", "expected").count() == 3
        got = {r.case_id: (r.res, r.diff_rows, r.error) for r in parity.verdicts(rows, results.sides_of(rows), profile).collect()}
        assert got == {"a": (1, 0, None), None: (0, 1, "rows without a case")}


def test_stream_state_outlives_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    lines = lambda rows: spark.createDataFrame([(json.dumps(dict(zip(("case_id", "res", "level", "ts"), r))),) for r in rows], "value string")
    days = lambda d: f"2024-01-{d:02} 00:00:00"
    batches = [
        [(1, 1, "x", days(10)), (2, 0, "x", days(10)), (1, 1, "x", days(10))],
        [(2, 0, "x", days(10)), (3, 1, "y", days(5)), (4, 1, "y", days(12))],  # one repeat, one that is late
        [(4, 1, "y", days(12)), (5, 0, "y", days(30)), (None, 1, "y", days(30))],
    ]
    for rows in batches:
        lines(rows).coalesce(1).write.mode("append").text(source)
        stream_accuracy(spark, source, out, check, delay="20 days").awaitTermination()
    got = {r.level: (r.n, r.n_correct) for r in metrics.totals(spark.read.parquet(f"{out}/totals")).collect()}
    assert got == {"x": (2, 1), "y": (3, 2)}
    assert sorted(r.case_id for r in spark.read.parquet(f"{out}/verdicts").collect()) == [1, 2, 3, 4, 5]


def test_three_phase_and_full_log(spark, tmp_path):
    flat = spark.createDataFrame(
        [(1, "how many", "shop", "", "SELECT 9", None), (2, "which", "none", "k", None, None)],
        "question_id bigint, question string, db_id string, knowledge string, gold_sql string, gold_code string",
    )
    card = spark.createDataFrame([("shop", "CREATE")], "db_id string, card string")
    templates = {
        "probe": [cards.Part("card", suffix=" "), cards.Part("question")],
        "oracle": [cards.Part("inquiry"), cards.Part("gold_sql", prefix=" gold ")],
        "final": [cards.Part("knowledge", prefix="K:", suffix=" ", otherwise="- "), cards.Part("question")],
    }
    target = lambda p: f"```sql\n{p};\n```" if "Note" in p else f"ask {p}"
    oracle = lambda p: json.dumps({"classification": ["Scope"], "answer": f"<{p}>"})
    final, phases = generate.three_phase(flat, card, target, oracle, templates, str(tmp_path / "p"))
    got = {r.question_id: r.final for r in final.collect()}
    assert got == {
        1: "SELECT K: Note: <ask CREATE how many gold SELECT 9> how many",
        2: "SELECT K:k Note: <ask which> which",
    }
    log = {r.question_id: r for r in metrics.full_log(flat, phases, final).collect()}
    assert (log[1].inquiry, log[1].categories, log[2].gold) == ("ask CREATE how many", ["Scope"], "")


def test_cases_isolate_failures(spark):
    db = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")}
    runs = [
        cases.Case("same", "d", "SELECT s, n FROM t", lambda t: t["t"].select("s", "n")),
        cases.Case("none", "d", "SELECT n FROM t WHERE n > 5", lambda t: t["t"].select("n").filter("n < 0")),
        cases.Case("fails late", "d", "SELECT n FROM t", lambda t: t["t"].select(F.expr("raise_error('x')").alias("n"))),
        cases.Case("fails early", "d", "SELECT n FROM nowhere", lambda t: t["t"]),
    ]
    rows, sides = cases.run_cases(spark, runs, {"d": db})
    got = {r.case_id: r for r in parity.verdicts(rows, sides).collect()}
    assert {k: r.res for k, r in got.items()} == {"same": 1, "none": 1, "fails late": 0, "fails early": 0}
    assert got["none"].level == "empty" and "actual side failed" in got["fails late"].error


def test_cases_see_their_own_tables_and_rerun_adds_nothing(spark, tmp_path):
    one, two = ({"only_a": spark.createDataFrame([(1,)], "n int")}, {"only_b": spark.createDataFrame([(1,)], "n int")})
    spark.range(7).createOrReplaceTempView("only_a")
    runs = [
        cases.Case("own", "a", "SELECT n FROM only_a", "SELECT n FROM only_a"),
        cases.Case("foreign", "a", "SELECT n FROM only_a", "SELECT n FROM only_b"),
        cases.Case("other", "b", "SELECT n FROM only_b", "SELECT n FROM only_b"),
    ]
    path, seen = str(tmp_path / "cases"), []
    for _ in range(2):
        rows, sides = cases.run_cases(spark, runs, {"a": one, "b": two}, path)
        seen.append((rows.count(), {r.case_id: r.res for r in parity.verdicts(rows, sides).collect()}))
    assert seen[0] == seen[1] == (5, {"own": 1, "foreign": 0, "other": 1})
    assert spark.table("only_a").count() == 7 and not spark.catalog.tableExists("only_b")
    spark.catalog.dropTempView("only_a")


def test_cases_wait_where_the_cluster_failed(spark, tmp_path):
    calls = []

    def flaky(t):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("Lost executor 3")
        return t["t"]

    db, path = {"d": {"t": spark.range(3)}}, str(tmp_path / "cases")
    run = lambda: cases.run_cases(spark, [cases.Case("c", "d", "SELECT id FROM t", flaky)], db, path)
    rows, sides = run()
    assert parity.verdicts(rows, sides).count() == 0
    rows, sides = run()
    assert [r.res for r in parity.verdicts(rows, sides).collect()] == [1] and rows.count() == 6


def test_three_phases_wait_for_an_earlier_one(spark, tmp_path):
    flat = spark.createDataFrame(
        [(1, "fine", "shop", "", "SELECT 9", None), (2, "late", "shop", "", "SELECT 8", None)],
        "question_id bigint, question string, db_id string, knowledge string, gold_sql string, gold_code string",
    )
    card = spark.createDataFrame([("shop", "CREATE")], "db_id string, card string")
    templates = {
        "probe": [cards.Part("question")], "oracle": [cards.Part("inquiry"), cards.Part("gold_sql", prefix=" gold ")],
        "final": [cards.Part("knowledge", suffix=" "), cards.Part("question")],
    }
    down = tmp_path / "down"
    down.touch()

    def target(prompt):
        if "late" in prompt and "Note" not in prompt and down.exists():
            raise TimeoutError("connection timed out")
        return f"```sql\n{prompt};\n```" if "Note" in prompt else f"ask {prompt}"

    oracle = lambda p: json.dumps({"answer": f"<{p}>"})
    run = lambda: {r.question_id: (r.status, r.final) for r in generate.three_phase(flat, card, target, oracle, templates, str(tmp_path / "p"))[0].collect()}
    first = run()
    assert first == {1: ("ok", "SELECT Note: <ask fine gold SELECT 9> fine"), 2: ("transient", None)}
    down.unlink()
    assert run() == run() == {1: first[1], 2: ("ok", "SELECT Note: <ask late gold SELECT 8> late")}
    _, phases = generate.three_phase(flat, card, target, oracle, templates, str(tmp_path / "p"))
    assert phases.count() == 6
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7  # one failed probe, no other call was made twice


def test_accuracy_counts(spark):
    verdicts = spark.createDataFrame([("1", 1), ("2", 0), ("3", 1), ("4", 1), ("5", 1)], "case_id string, res int")
    strata = spark.createDataFrame(
        [("1", "simple", 1), ("2", "simple", 1), ("3", "simple", 1), ("3", "moderate", 2), ("4", "other", 1), ("9", "simple", 1)],
        "case_id string, difficulty string, pos int",
    )
    got = {r.level: (r.n, r.n_correct, r.accuracy) for r in metrics.accuracy(verdicts, strata, order="pos").collect()}
    assert got["simple"] == (2, 1, 50.0) and got["moderate"] == (1, 1, 100.0) and got["challenging"] == (0, 0, 0.0)
    assert got["total"][:2] == (3, 2)


def test_evaluate_is_idempotent(spark, tmp_path):
    preds = spark.createDataFrame(
        [(1, 0, "[[2],[1]]"), (1, 1, "[[9]]"), (2, 2, "5"), (3, 3, "[]"), (4, 4, "1")], "question_id bigint, pos int, output string"
    )
    gold = spark.createDataFrame(
        [(1, 0, "[[1],[2]]", "simple"), (2, 1, "6", "simple"), (3, 2, None, "moderate")],
        "question_id bigint, pos int, output string, difficulty string",
    )
    for _ in range(2):
        verdicts, acc = evaluate.evaluate(preds, gold, str(tmp_path / "ledger"))
        rows = {r.case_id: r for r in verdicts.collect()}
        assert {k: r.res for k, r in rows.items()} == {"1": 1, "2": 0, "3": 0, "4": 0}
        assert rows["3"].error == "expected side missing" and verdicts.count() == 4
    assert {r.level: r.n_correct for r in acc.collect()} == {"simple": 1, "moderate": 0, "challenging": 0, "total": 1}


def test_stream_equals_batch(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    lines = [{"case_id": i % 40, "res": i % 2, "seq": i} for i in range(100)]
    (source / "a.json").write_text("\n".join(map(json.dumps, lines[:70])) + "\n{broken\n")

    def run():
        stream_verdicts(spark, str(source), path, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("case_id bigint, res int, seq bigint").parquet(path).collect())

    want = sorted((i, i % 2, i) for i in range(40))
    assert run() == want
    (source / "b.json").write_text("\n".join(map(json.dumps, lines[70:] + [{"case_id": 99, "res": 1, "seq": 100}])))
    assert run() == want + [(99, 1, 100)]
    assert run() == want + [(99, 1, 100)]


def test_profile_approx_and_exact(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 1.5), (2, None, 0.5)], "k int, s string, x double")
    exact = {r.column_name: r for r in cards.profile_tables({"t": df, "sqlite_sequence": df}, "d", distinct="exact").collect()}
    approx = {r.column_name: r for r in cards.profile_tables({"t": df}, "d").collect()}
    assert {k: r.n_distinct for k, r in exact.items()} == {k: r.n_distinct for k, r in approx.items()} == {"k": 2, "s": 2, "x": 2}
    assert (exact["s"].n_null, exact["s"].min_text, exact["x"].max_text) == (1, "a", "1.5")


def test_sample_card(spark):
    df = spark.createDataFrame([(10, "ab"), (2, None)], "n int, name string")
    card = cards.sample_card(df, 5, ["n"], "order").first()["card"]
    assert card == "/* \n 5 example rows: \n SELECT * FROM `order` LIMIT 5; \n  n name \n 2 None \n10   ab  \n */"
    with_rows = cards.schema_cards(spark, {"d": {"t": df}}, sample_rows=1, order={"t": ["n"]}).first()["card"]
    assert with_rows.startswith("CREATE TABLE t (") and "1 example rows" in with_rows
