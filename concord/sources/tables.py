"""Reading CSV folders, question corpora and JSON-lines ledgers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.session import materialise

CORPUS_FIELDS = (
    "question_id", "idx", "db_id", "question", "evidence", "verified_knowledge", "difficulty",
)


_BUILT_IN = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


def _csv_reader(spark: SparkSession, schema: T.StructType | str | None, encoding: str, multi_line: bool):
    reader = (
        spark.read.option("header", True).option("encoding", encoding)
        .option("escape", '"').option("multiLine", multi_line)
    )
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def read_table_dir(
    spark: SparkSession, path: str, schemas: Mapping[str, T.StructType | str] | None = None,
    encodings: Sequence[str] = ("UTF-8", "GBK"), multi_line: bool | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every CSV file or folder ``<table>.csv`` as a table named by its stem, and a status frame.

    The status frame ``table_name, encoding, status`` also lists the tables that could not be read. One pass over
    the lines of the folder finds the tables that are not UTF-8, which take the second encoding, and those with a
    quote left open at the end of a line, whose cells hold line breaks: only these are read a file by a task
    (``multi_line`` decides for all), the files of others are split. With a schema a table needs no inference pass.
    An encoding that Spark does not know by itself needs its setting for older charsets: such a table is
    stored while that is on, and the setting is put back.
    """
    # Only the names come to the driver, however many part files the folders hold.
    name_of = lambda file: F.regexp_extract(file, r"(?i)/([^/]+\.csv)(?:/[^/]*)?$", 1).alias("name")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name_of("path"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("recursiveFileLookup", True).text(path).groupBy(name_of("_metadata.file_path")).agg(
        F.max(~F.is_valid_utf8("value")).alias("odd"), F.max(quotes % 2 == 1).alias("open")
    )
    tables, status = {}, []
    for row in sorted(names.filter("name <> ''").distinct().join(lines, "name", "left").collect()):
        name = unquote(row.name)
        file, name = f"{path.rstrip('/')}/{name}", name[: -len(".csv")]
        encoding = encodings[1] if row.odd and len(encodings) > 1 else encodings[0]
        broken = bool(row.open) if multi_line is None else multi_line
        read = lambda: _csv_reader(spark, (schemas or {}).get(name), encoding, broken).csv(file)
        try:
            tables[name] = read() if encoding.upper() in _BUILT_IN else _stored_with_older_charsets(spark, read, name)
            status.append((name, encoding, "ok"))
        except Exception as e:
            status.append((name, encoding, f"skipped: {type(e).__name__}"))
    return tables, spark.createDataFrame(status, "table_name string, encoding string, status string")


def _stored_with_older_charsets(spark: SparkSession, read: Callable[[], DataFrame], name: str) -> DataFrame:
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return materialise(read(), f"csv-{name}")
    finally:
        spark.conf.set(setting, before)


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question records from a JSON array, a single object, or one object per line.

    An array is cut into the texts of its records first, by one task a file, so its size is bounded by that of
    a Spark text (2 GB) and not by that of a variant; a file that cannot be parsed raises. Larger corpora
    come one object per line, where files are split; a line that cannot be parsed has null fields. Each record is
    read as a variant: fields whose names differ only in case stay apart, and fields that hold a text in one
    record and a list in another need no common type. Gold fields come out as text (a list as JSON),
    ``output`` as JSON text. ``pos`` is the place of a record in its array.
    """
    if lines:
        texts = spark.read.text(path).filter(F.trim("value") != "")
        record = texts.select(F.lit(0).alias("pos"), F.try_parse_json("value").alias("r"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^[\\s\ufeff]+", "").alias("value"))
        cut = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
        items = F.when(F.startswith("value", F.lit("[")), cut).otherwise(F.array("value"))
        record = whole.select(F.posexplode(items).alias("pos", "text")).select("pos", F.parse_json("text").alias("r"))
    text = lambda name: F.try_variant_get("r", f"$.{name}", "string").alias(name)
    number = lambda name: F.try_variant_get("r", f"$.{name}", "bigint").alias(name)
    gold = [
        F.coalesce(*[F.nullif(F.coalesce(F.try_variant_get("r", f"$.{n}[0]", "string"), F.try_variant_get("r", f"$.{n}", "string")), F.lit("")) for n in names]).alias(alias)
        for names, alias in ((("sql", "query", "SQL"), "gold_sql"), (("code",), "gold_code"))
    ]
    output = F.to_json(F.try_variant_get("r", "$.output", "variant"))
    return record.select(
        "pos", *[number(n) if n in ("question_id", "idx") else text(n) for n in CORPUS_FIELDS], *gold,
        F.nullif(output, F.lit("null")).alias("output"),
    )


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good records of a JSON-lines file, and its malformed lines. Blank lines are skipped."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    marked = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = (
        spark.read.text(path).filter(F.trim("value") != "")
        .select("value", F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    )
    broken = F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~broken).select(*[f"r.{f.name}" for f in schema]), parsed.filter(broken).select(F.col("value").alias("line"))
