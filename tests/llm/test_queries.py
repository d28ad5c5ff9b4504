"""Registered queries against their SQL, and the pipeline as a whole."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from concord.llm.registry import ORACLES
from concord.session import materialise
from tests.llm import helpers as H

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert check.compare(spark, check.connect(SF_DIR), SF_DIR, name).startswith("ok")


def test_pipeline(spark):
    """Each stage judged on its own input; the last holds every kept document."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    con, columns = duckdb.connect(), docs.columns
    bad = {i for i, q in con.execute(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall() if q == 0}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF_DIR), "test-stage")
        seen.append((name, before, docs))
    first, near_, leaks, mix, ids = seen
    assert all(list(after.columns) == columns for _, _, after in seen[:-1])
    assert len({r.doc_id for r in first[2].collect()} & bad) <= 0.2 * len(bad)
    rows = [tuple(r)[:4] for r in near_[1].collect()]
    want = {c if n else i for i, n, c in H.near_components(rows)}
    assert sorted(r.doc_id for r in near_[2].collect()) == sorted(want)
    assert leaks[2].count() < leaks[1].count()
    assert {r.doc_id for r in mix[2].collect()} <= {r.doc_id for r in mix[1].collect()}
    assert sorted(r.doc_id for r in ids[2].collect()) == sorted(r.doc_id for r in ids[1].collect())



def test_pipeline_on_odd_rows(spark):
    """Null and repeated ids, rows that differ in other columns alone, null and empty texts, columns of clashing names."""
    rng = random.Random(1)
    leak = duckdb.connect().execute(f"SELECT text FROM '{SF_DIR}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchone()[0]
    clean = [H.prose(rng, 90, 3000).capitalize() + "." for _ in range(6)]
    rows = [(None, clean[0], "en", "a"), (None, clean[1], "en", "a"), (None, f"{clean[2]} {leak}", "en", "a"), (7, clean[3], "en", "b"), (7, clean[3], "en", "c")]
    rows += [(7, clean[4], None, None), (8, None, None, None), (9, "", "en", "b"), (10, clean[5], "en", "b")]
    docs = H.documents(spark, rows, clashing=True)
    kept = materialise(docs, "odd-rows")
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, SF_DIR), "odd-stage")
        assert kept.columns == docs.columns
        texts.append([r.text for r in kept.collect()])
    assert not any(leak in (t or "") for t in texts[2]) and set(texts[2]) <= set(texts[1]) <= set(texts[0])
    assert len(texts[1]) == len(set(texts[1])) or None in texts[1]
    encoded = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    assert encoded.count() == len(texts[3])


def test_pipeline_on_nothing(spark):
    docs = H.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 0
