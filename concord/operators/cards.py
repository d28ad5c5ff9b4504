"""Key reports, column profiles, schema cards and prompt tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table names quoted on a sample card.
RESERVED_NAMES = ("order", "by", "group")
SYSTEM_TABLES = ("sqlite_sequence",)


def key_report(df: DataFrame, candidates: Sequence[str | Sequence[str]]) -> DataFrame:
    """Whether declared keys hold: ``key, n_rows, n_distinct, n_null, is_key``.

    Each key is counted by its own two-step aggregation, which spreads a hot key value and never
    multiplies the rows by the number of keys.
    """
    def one(key: str | Sequence[str]) -> DataFrame:
        names = [key] if isinstance(key, str) else list(key)
        any_null = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
        groups = df.groupBy(*names).agg(F.count("*").alias("n")).withColumn("bad", any_null)
        return groups.agg(
            F.lit(",".join(names)).alias("key"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count(F.when(~F.col("bad"), 1)).alias("n_distinct"),
            F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("n_null"),
        ).withColumn("is_key", (F.col("n_rows") == F.col("n_distinct")).cast("int"))

    return reduce(DataFrame.union, [one(k) for k in candidates])


def _profile_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]


def profile_table(df: DataFrame, table: str, distinct: str = "approx") -> DataFrame:
    """``table_name, column_name, n_rows, n_null, n_distinct, min_text, max_text`` for each column.

    One aggregation pass over the table. ``distinct="exact"`` counts distinct values by a second
    pass that groups by (column, value), so that no column gathers in one task.
    """
    fields = _profile_columns(df)
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if distinct == "approx":
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    no_count = F.lit(None).cast("bigint")
    stats = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), (F.col("n") - F.col(f"c{i}")).alias("n_null"),
            (F.col(f"d{i}") if distinct == "approx" else no_count).alias("n_distinct"),
            F.col(f"lo{i}").alias("min_text"), F.col(f"hi{i}").alias("max_text"),
        )
        for i, f in enumerate(fields)
    ])
    wide = df.agg(*aggs).select("n", F.explode(stats).alias("s"))
    out = wide.select(
        F.lit(table).alias("table_name"), "s.column_name", F.col("n").alias("n_rows"), "s.n_null", "s.n_distinct",
        "s.min_text", "s.max_text",
    )
    if distinct == "approx":
        return out
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).cast("string").alias("v")) for f in fields])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.column_name", "p.v").filter("v is not null")
        .groupBy("column_name", "v").agg(F.lit(1).alias("one"))
        .groupBy("column_name").agg(F.count("*").alias("found"))
    )
    return out.join(counts, "column_name", "left").select(
        "table_name", "column_name", "n_rows", "n_null",
        F.coalesce("found", F.lit(0).cast("bigint")).alias("n_distinct"), "min_text", "max_text",
    )


def profile_tables(
    tables: Mapping[str, DataFrame], db_id: str, exclude: Sequence[str] = SYSTEM_TABLES, distinct: str = "approx"
) -> DataFrame:
    """Column profiles of all tables of a database, once per database."""
    parts = [profile_table(df, name, distinct) for name, df in tables.items() if name not in exclude]
    return reduce(DataFrame.union, parts).select(F.lit(db_id).alias("db_id"), "*")


def table_ddl(name: str, schema: T.StructType) -> str:
    """Table definition text from a schema alone."""
    columns = ",\n".join(f"  {f.name} {f.dataType.simpleString()}" for f in schema)
    return f"CREATE TABLE {name} (\n{columns}\n)"


def schema_cards(
    spark: SparkSession, databases: Mapping[str, Mapping[str, DataFrame]],
    exclude: Sequence[str] = SYSTEM_TABLES, sample_rows: int = 0, order: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``db_id, card``: the definitions of a database's tables, divided by blank lines.

    Made from schemas, once per database; with ``sample_rows`` each definition is followed by the
    first rows of the table, in the order given for it.
    """
    ddl = [
        (db_id, pos, name, table_ddl(name, df.schema))
        for db_id, tables in databases.items()
        for pos, (name, df) in enumerate(t for t in tables.items() if t[0] not in exclude)
    ]
    cards = spark.createDataFrame(ddl, "db_id string, pos int, table_name string, ddl string")
    if sample_rows:
        samples = [
            sample_card(df, sample_rows, (order or {}).get(name, df.columns[:1]), name)
            .select(F.lit(db_id).alias("db_id"), F.lit(name).alias("table_name"), "card")
            for db_id, tables in databases.items() for name, df in tables.items() if name not in exclude
        ]
        cards = cards.join(reduce(DataFrame.union, samples), ["db_id", "table_name"], "left").withColumn(
            "ddl", F.concat_ws(" \n ", "ddl", "card")
        )
    # Bounded group: the tables of one database.
    return cards.groupBy("db_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ddl"))), lambda s: s["ddl"]), "\n\n").alias("card")
    )


def sample_text(df: DataFrame, n: int, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``card``: the first ``n`` rows under a header, right-justified, each value followed by a space."""
    columns = list(columns or df.columns)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    # At most n rows from here on.
    first = df.orderBy(*order).limit(n).select(F.struct(*order).alias("k"), F.array(*texts).alias("r"))
    rows = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]).alias("rows"))
    header = F.array(*[F.lit(c) for c in columns])
    everything = F.concat(F.array(header), F.col("rows"))
    widths = F.array(*[
        F.array_max(F.transform(everything, lambda r: F.length(F.get(r, F.lit(i))))) for i in range(len(columns))
    ])
    line = lambda r: F.array_join(
        F.transform(r, lambda v, i: F.concat(F.lpad(v, F.greatest(F.get(F.col("widths"), i), F.length(v)), " "), F.lit(" "))), ""
    )
    return rows.select(everything.alias("lines"), widths.alias("widths")).select(
        F.array_join(F.transform("lines", line), "\n").alias("card")
    )


def sample_card(df: DataFrame, n: int, order: Sequence[str], table: str) -> DataFrame:
    """The sample rows as a comment that names the query they answer."""
    # The layout of the comment.
    name = f"`{table}`" if table in RESERVED_NAMES else table
    head = f"/* \n {n} example rows: \n SELECT * FROM {name} LIMIT {n}; \n "
    return sample_text(df, n, order).select(F.concat(F.lit(head), "card", F.lit(" \n */")).alias("card"))


# --- prompts -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A piece of a prompt: fixed text, or a column between a prefix and a suffix.

    A column part is left out, with prefix and suffix, where the column is empty; ``otherwise`` is
    the text used then. ``replace`` gives a fixed text in place of the column's value.
    """

    column: str | None = None
    prefix: str = ""
    suffix: str = ""
    otherwise: str = ""
    replace: str | None = None

    def expression(self) -> Column:
        if self.column is None:
            return F.lit(self.prefix)
        value = F.col(self.column).cast("string")
        body = F.lit(self.replace) if self.replace is not None else value
        return F.when(
            F.coalesce(value, F.lit("")) != "", F.concat(F.lit(self.prefix), body, F.lit(self.suffix))
        ).otherwise(self.otherwise)


def text(value: str) -> Part:
    return Part(prefix=value)


def build_prompts(
    corpus: DataFrame, cards: DataFrame, template: Sequence[Part], keys: Sequence[str] = ("question_id", "db_id")
) -> DataFrame:
    """``keys, prompt`` for every question, its database's card available as column ``card``.

    The cards are joined without a forced strategy: their sizes decide whether they are broadcast.
    """
    joined = corpus.join(cards.select("db_id", "card"), "db_id", "left")
    return joined.select(*keys, F.concat(*[p.expression() for p in template]).alias("prompt"))


def with_note(knowledge: Column, answer: Column) -> Column:
    """Knowledge extended by an answer as a note."""
    k = F.coalesce(knowledge, F.lit(""))
    return F.when(F.coalesce(answer, F.lit("")) != "", F.concat(k, F.lit(" Note: "), answer)).otherwise(k)
