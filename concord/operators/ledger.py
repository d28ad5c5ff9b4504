"""Predictions, done sets and the verdict ledger.

"First" and "last" are found by an aggregate that combines on the map side, so an id that holds a
large part of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT_SCHEMA = (
    "case_id string, res int, level string, diff_rows bigint, error string, "
    "db_id string, judge_text string"
)


def _one_per_id(df: DataFrame, key: str, order: str | Column, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    pick = F.max_by if last else F.min_by
    order = F.col(order) if isinstance(order, str) else order
    # A record without an order comes after all others (first) or before them (last), but is never lost.
    order = F.struct(order.isNotNull() if last else order.isNull(), order)
    return df.groupBy(key).agg(pick(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The first record of each id in the given order, which must be unique within an id.

    Records without an order count only where an id has no other.
    """
    return _one_per_id(df, key, order, last=False)


def latest_entry(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The last record of each id in the given order; records without one only where there is no other."""
    return _one_per_id(df, key, order, last=True)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with how many records the keep-first rule drops."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return counted.filter("n > 1").select(key, "n", (F.col("n") - 1).alias("n_dropped"))


def pending(corpus: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a finished record."""
    return corpus.join(done.select(key), key, "left_anti")


def finished(ledger: DataFrame, key: str = "question_id") -> DataFrame:
    """Done set of a stage ledger: everything but rows whose failure may pass."""
    return ledger.filter(F.coalesce(F.col("status"), F.lit("ok")) != "transient").select(key).distinct()


def attach_expected(preds: DataFrame, corpus: DataFrame, key: str = "question_id", order: str = "pos") -> DataFrame:
    """Predictions with the output of the first corpus record of their id.

    ``status`` is ``ok``, or ``missing`` where no output is found.
    """
    first = keep_first(corpus.select(key, F.col(order).alias("_order"), "output"), key, "_order").drop("_order")
    return preds.join(first, key, "left").withColumn(
        "status", F.when(F.col("output").isNull(), "missing").otherwise("ok")
    )


def new_rows(batch: DataFrame, ledger: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The first record of each id of a batch that the ledger does not hold yet."""
    return keep_first(batch, key, order).join(ledger.select(key), key, "left_anti")


def append_new(batch: DataFrame, path: str, key: str, order: str | Column) -> None:
    """Append the new rows of a batch to a ledger table; repeating it adds nothing."""
    spark = batch.sparkSession
    ledger = read_table(spark, path, batch.schema)
    new_rows(batch, ledger, key, order).write.mode("append").parquet(path)


def append_batch(batch: DataFrame, path: str, name: str, key: str, order: str | Column) -> None:
    """Add the new rows of a named batch as a partition of a ledger that several writers may add to at once.

    Rows whose id a batch of an earlier name holds stay out. A batch that is written again takes the place of its own
    partition alone. Writers that do not see each other may both add an id; ``read_batches`` settles that.
    """
    held = _batches(batch.sparkSession, path, batch.schema).filter(F.col("batch") < name)
    new = new_rows(batch, held, key, order).withColumn("batch", F.lit(name))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _batches(spark, path: str, schema) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)
    return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.StringType())]))


def read_batches(spark, path: str, schema, key: str) -> DataFrame:
    """A ledger of named batches: of an id that several hold, the record of the batch whose name comes first.

    So names should sort by time. The answer is the same for every reader, whatever order the batches were written in.
    """
    return keep_first(_batches(spark, path, schema), key, "batch").drop("batch")


def read_table(spark, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty frame of the schema where nothing was written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def path_exists(spark, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def order_by_case(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    return verdicts.orderBy(key)
