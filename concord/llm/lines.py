"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.registry import query, table
from concord.session import materialise

#: Fixed value: what is cut from both ends of a line before it is compared.
BLANK = " \t\r\x0b\x0c"
_ROW = ["no_id", "id", "text_hash"]


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """A document's place in the order: by id, those without one last, then by text."""
    return docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text_hash"), *more,
    )


def _lines() -> Column:
    """Lines with a word in them, each with its place among all lines."""
    at = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x, F.lit(BLANK)).alias("line"), i.alias("at")))
    return F.filter(at, lambda x: x["line"] != "")


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """Every window of ``size`` consecutive lines: two hashes of it, and the places it covers.

    Blank lines are passed over. A document with fewer lines is one window.
    """
    held = _keyed(docs, _lines().alias("lines")).filter(F.size("lines") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0)))
    at = held.select(*_ROW, "lines", F.explode(starts).alias("start"))
    line = [F.get("lines", F.col("start") + i) for i in range(size)]
    texts = [x["line"] for x in line]
    return at.select(
        *_ROW, "start", F.xxhash64(*texts).alias("w1"), F.xxhash64(F.lit(1), *texts).alias("w2"), F.array(*[x["at"] for x in line]).alias("places")
    )


def repeated_places(docs: DataFrame, size: int = 3) -> DataFrame:
    """Per document, the places of lines that a repeat of an earlier window covers.

    The first window in the order of ids and places is kept. Windows are counted and their first found by
    a combined aggregation; only windows that do repeat enter the join, so a window that many documents
    share is split there by adaptive execution.
    """
    every = windows(docs, size)
    order = F.struct(*_ROW, "start")
    again = every.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = every.join(materialise(again, "windows"), ["w1", "w2"]).filter(order != F.col("first"))
    return later.select(*_ROW, F.explode("places").alias("at")).filter("at is not null").groupBy(*_ROW).agg(F.collect_set("at").alias("covered"))


def dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` per document, without lines of repeated windows.

    ``n_lines`` counts lines with a word. A null text stays null, with no lines; a text that is all
    repeats becomes empty. Rows that agree in id and text are one document in the order and get the same
    result. Documents without an id come last in the order.
    """
    # always by a shuffle of the texts, at any size: covered grows with the input, so it is not broadcast
    covered = materialise(repeated_places(docs, size), "covered").hint("merge")
    held = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(covered, _ROW, "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    return held.select(
        "doc_id", F.coalesce(F.size(_lines()), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).alias("text"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))


_CUT = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_SQL = f"""
WITH a AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
l AS (SELECT *, trim(raw, {_CUT}) AS line FROM a),
b AS (SELECT doc_id, pos, line, row_number() OVER d AS i, count(*) OVER (PARTITION BY doc_id) AS n,
    lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3, lead(pos, 1) OVER d AS pos2, lead(pos, 2) OVER d AS pos3
  FROM l WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS nr FROM b WHERE i <= greatest(n - 2, 1)),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos2, pos3]) AS pos FROM w WHERE nr > 1),
r AS (SELECT l.doc_id, count(*) FILTER (line <> '') AS n_lines, count(c.pos) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '') AS text
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


@query("op3_line_dedup", _SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
