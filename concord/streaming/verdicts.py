"""Verdicts from a growing folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from concord.operators import ledger

INPUT_SCHEMA = "case_id bigint, res int, seq bigint"


def unread_path(path: str) -> str:
    """Where the lines that gave no record are kept, a folder for each batch."""
    return path.rstrip("/") + "-unread"


def stream_verdicts(
    spark: SparkSession, source: str, path: str, checkpoint: str, schema: str = INPUT_SCHEMA,
    key: str = "case_id", order: str = "seq",
) -> StreamingQuery:
    """Feed a verdict ledger from JSON-lines files; stops when all present files are read.

    Each micro-batch keeps the first record of an id and adds only ids the ledger lacks, so a batch that is
    repeated after a failure changes nothing. Lines that do not parse or have no id are kept, as ``line``,
    in the table ``unread_path(path)``, which a repeated batch writes over.
    """
    fields = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    good = F.col("r._corrupt_record").isNull() & F.col(f"r.{key}").isNotNull()

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        ledger.append_new(batch.filter(good).select(*[f"r.{f.name}" for f in fields[:-1]]), path, key, order)
        unread = batch.filter(~good).select(F.col("value").alias("line"))
        unread.write.mode("overwrite").parquet(f"{unread_path(path)}/batch={number}")
        batch.unpersist()

    parsed = F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    stream = spark.readStream.text(source).filter(F.trim("value") != "").select("value", parsed)
    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


STATED_SCHEMA = "case_id bigint, res int, level string, ts timestamp"


def stream_accuracy(
    spark: SparkSession, source: str, path: str, checkpoint: str, schema: str = STATED_SCHEMA, key: str = "case_id",
    time: str = "ts", delay: str = "7 days", files: int | None = None,
) -> StreamingQuery:
    """Verdicts from JSON-lines files into ``path``, with counts by level kept as they come in.

    Ids seen are held as state of the stream, so no batch reads what was written before: a record whose id came up to
    ``delay`` of event time earlier is a repeat and is passed over; records older than that are too late and are not
    counted. Records of an id are taken to agree; where they differ, one of those that come first counts. Every
    micro-batch writes its rows and its counts to partitions of its own number, which it writes over if it is
    repeated. ``metrics.totals`` adds up ``path/totals``. Stops when all present files are read.
    """
    fields = T.StructType.fromDDL(schema)
    reader = spark.readStream.schema(fields)
    parsed = (reader.option("maxFilesPerTrigger", files) if files else reader).json(source)
    fresh = parsed.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        counts = batch.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("res") == 1).alias("n_correct"))
        counts.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
        batch.unpersist()

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
