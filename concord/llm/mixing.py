"""Mixing sources to target weights: water-filled targets, then Pareto order sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.registry import query, table
from concord.session import materialise

#: Fixed value: words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
_BINS = 1024


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(df: DataFrame, by: list[str], rate: str, cap: str, total: str, order: list, out: str) -> DataFrame:
    """Share ``total`` in proportion to ``rate``; what ``cap`` holds back is shared again until none is above.

    Rows are taken by the level at which each is full. Before the first that stays below its cap, all are
    full; what they leave, over the rates that remain, is the level of the rest.
    """
    side, seen = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col("_full"), *order)
    upto = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_full", F.col(cap) / F.col(rate))
    df = df.withColumns({"_nr": F.row_number().over(seen), "_caps": F.sum(cap).over(upto) - F.col(cap), "_rates": F.sum(rate).over(side) - F.sum(rate).over(upto) + F.col(rate)})
    df = df.withColumn("_level", (F.col(total) - F.col("_caps")) / F.col("_rates"))
    below = F.col("_level") * F.col(rate) < F.col(cap)
    df = df.withColumn("_level", F.min(F.when(below, F.struct("_nr", "_level"))).over(side)["_level"])
    value = F.when(F.col("_level").isNull(), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.col("_level") * F.col(rate)))
    return df.withColumn(out, value).drop("_full", "_nr", "_caps", "_rates", "_level")


def sized(docs: DataFrame, weight: str | None = None, seed: str = "mix", row: Column | None = None) -> DataFrame:
    """What the plan reads of a document: ``id, no_source, source, level, size, u``, and ``row`` if given.

    ``u`` in (0, 1) comes from the id, so reruns agree. ``weight`` (more copies of heavier documents)
    is used to two significant digits, null or not above zero as the least weight 1e-6.
    """
    if weight is None:
        level = F.lit(1.0)
    else:
        w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-6))
        step = F.pow(F.lit(10.0), F.floor(F.log10(w)) - 1)
        level = F.round(w / step) * step
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), level.alias("level"), n_words("text").alias("size"), u.alias("u"),
        *([] if row is None else [row.alias("row")]),
    )


_SOURCE = ["no_source", "source"]
_RANK = ["xi", "id", "size"]


def _with_plan(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Expected copies of each row, their whole part, and the Pareto rank of the rest."""
    rows = rows.join(levels, [*_SOURCE, "level"], "left")
    part = F.col("copies") - F.floor("copies")
    odds = lambda p: p / (1 - p)
    return rows.withColumns({"whole": F.coalesce(F.floor("copies"), F.lit(0)), "xi": F.when(part > 0, odds(F.col("u")) / odds(part))})


def _drawn(gaps: list[str]) -> Column:
    """Whether a row is in the sample of any pass so far."""
    rank = F.struct(*_RANK)
    hits = [F.coalesce((F.col("size") <= F.col(f"gap{g}")) & (rank <= F.col(f"cut{g}")), F.lit(False)) for g in gaps]
    return F.col("xi").isNotNull() & (F.col("size") > 0) & reduce(lambda a, b: a | b, hits, F.lit(False))


def plan(rows: DataFrame, cap: int = 3, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Targets and cuts: one row per source, and one per source and weight level.

    A source's target is its weighted share of all words, at most ``cap`` times its size. Expected copies
    of a document are proportional to its weight, at most ``cap``; their whole part is allocated for
    certain. The parts left over are inclusion probabilities of a Pareto order sample: documents go by
    random odds divided by inclusion odds, the smallest first, while their words fit into what the
    target still lacks. Each further pass offers what then is missing to documents that fit into it, so
    the miss shrinks to the size of a small document. Rows that agree in id and size go together.

    Cuts are found by word sums over bins of the rank and a running sum inside one bin, so no source is
    ever sorted whole. The windows over all sources hold one row per source.
    """
    sources = rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    everything, order = Window.partitionBy(), [F.col("no_source"), F.col("source")]
    nr = F.row_number().over(Window.orderBy(*order))
    sources = sources.withColumns({"share": ((nr - 1) % 3 + 1).cast("long"), "total": F.sum("source_size").over(everything), "most": F.col("source_size") * cap})
    sources = water_fill(sources, [], "share", "most", "total", order, "target").select(*_SOURCE, "source_size", "target")

    levels = rows.filter("size > 0").groupBy(*_SOURCE, "level").agg(F.sum("size").alias("words"))
    levels = levels.join(sources, _SOURCE).withColumns({"rate": F.col("words") * F.col("level"), "most": F.col("words") * cap})
    levels = water_fill(levels, _SOURCE, "rate", "most", "target", [F.col("level").desc()], "share")
    levels = materialise(levels.select(*_SOURCE, "level", "words", (F.col("share") / F.col("words")).alias("copies")), "levels")

    certain = levels.groupBy(*_SOURCE).agg(F.sum(F.floor("copies") * F.col("words")).alias("certain"))
    cuts = materialise(
        sources.join(certain, _SOURCE, "left").select(
            *_SOURCE, F.col("source_size"), F.col("target"), (F.col("target") - F.coalesce("certain", F.lit(0))).alias("gap0")
        ),
        "sources",
    )
    planned = _with_plan(rows, levels.drop("words"))
    for g in range(passes):
        open_rows = (
            planned.join(cuts, _SOURCE)
            .filter(F.col("xi").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col(f"gap{g}")) & ~_drawn([str(i) for i in range(g)]))
            .select(*_SOURCE, *_RANK, F.col(f"gap{g}").alias("gap"), F.floor(F.log("xi") * _BINS).alias("bin"))
        )
        upto = Window.partitionBy(*_SOURCE).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = open_rows.groupBy(*_SOURCE, "bin").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"), F.max(F.struct(*_RANK)).alias("last"))
        bins = materialise(bins.withColumn("sum", F.sum("words").over(upto)), "bins")
        over = F.col("sum") > F.col("gap")
        edge = bins.filter(over).groupBy(*_SOURCE).agg(F.min("bin").alias("bin"), F.min(F.struct("bin", (F.col("sum") - F.col("words")).alias("b")))["b"].alias("before"))
        within = Window.partitionBy(*_SOURCE).orderBy(*_RANK)  # peers count together
        inside = open_rows.join(edge, [*_SOURCE, "bin"]).withColumn("sum", F.col("before") + F.sum("size").over(within))
        last = inside.filter("sum <= gap").groupBy(*_SOURCE).agg(F.max(F.struct(F.col("sum"), F.struct(*_RANK).alias("cut"))).alias("in"))
        full = bins.filter(~over).groupBy(*_SOURCE).agg(F.max(F.struct(F.col("sum"), F.col("last").alias("cut"))).alias("all"))
        best = F.coalesce(F.col("in"), F.col("all"))
        cuts = cuts.join(full, _SOURCE, "left").join(last, _SOURCE, "left").withColumns(
            {f"cut{g}": best["cut"], f"gap{g + 1}": F.col(f"gap{g}") - F.coalesce(best["sum"], F.lit(0))}
        )
        cuts = materialise(cuts.drop("in", "all"), "cuts")
    return cuts, levels.drop("words")


def copies_of(rows: DataFrame, cuts: DataFrame, levels: DataFrame) -> DataFrame:
    """The rows of ``sized`` (other columns stay) with ``source_size, target`` and ``n``, the copies taken."""
    gaps = [c[3:] for c in cuts.columns if c.startswith("cut")]
    out = _with_plan(rows, levels).join(cuts, _SOURCE, "left")
    return out.withColumn("n", (F.col("whole") + F.when(_drawn(gaps), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weight: str | None = None, cap: int = 3) -> DataFrame:
    """Every document with the words the mix takes of it: ``doc_id, size, source_size, target, taken``.

    Null and empty texts have size 0 and nothing is taken of them; null sources are one source, the
    last. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = materialise(sized(docs, weight), "sizes")
    cuts, levels = plan(rows, cap)
    return copies_of(rows, cuts, levels).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    cuts, levels = plan(materialise(sized(docs), "sizes"), cap)
    rows = sized(docs, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    taken = copies_of(rows, cuts, levels).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).select("row.*")


_ORDER = "ORDER BY xi, id NULLS FIRST, size"
_SIDE = "PARTITION BY no_source, source"


def _pass_sql(g: int) -> str:
    return f"""
p{g} AS (SELECT *, sum(size) OVER ({_SIDE} {_ORDER}) AS words FROM r{g} WHERE NOT drawn AND xi IS NOT NULL AND size > 0 AND size <= gap),
r{g + 1} AS (SELECT r.* REPLACE (r.drawn OR coalesce(p.words <= p.gap, false) AS drawn, r.gap - coalesce(b.best, 0) AS gap)
  FROM r{g} r LEFT JOIN p{g} p ON p.nr = r.nr
  LEFT JOIN (SELECT no_source, source, max(words) AS best FROM p{g} WHERE words <= gap GROUP BY ALL) b ON b.no_source = r.no_source AND b.source = r.source)"""


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id AS id, source IS NULL AS no_source, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u
  FROM documents),
s AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS share
  FROM d GROUP BY no_source, source),
f AS (SELECT *, 3 * source_size AS most, 3 * source_size / share AS full_at FROM s),
l AS (SELECT *, row_number() OVER w AS nr, (sum(source_size) OVER () - sum(most) OVER w + most)
    / (sum(share) OVER () - sum(share) OVER w + share) AS level
  FROM f WINDOW w AS (ORDER BY full_at, no_source, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT l.*, CASE WHEN k.level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), k.level * share) END AS target
  FROM l, (SELECT arg_min(level, nr) AS level FROM l WHERE level * share < most) k),
c AS (SELECT no_source, source, source_size, target, CASE WHEN source_size = 0 THEN NULL
    WHEN target / source_size * source_size < most THEN least(CAST(most AS DOUBLE), target / source_size * source_size) / source_size
    ELSE CAST(most AS DOUBLE) / source_size END AS copies FROM t),
r0 AS (SELECT d.nr, id, no_source, source, size, source_size, target, CAST(coalesce(floor(copies), 0) AS BIGINT) AS whole,
    CASE WHEN copies > floor(copies) THEN (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS xi,
    target - coalesce(CAST(floor(copies) AS BIGINT) * source_size, 0) AS gap, false AS drawn
  FROM d JOIN c USING (no_source, source)),
{_pass_sql(0)}, {_pass_sql(1)}, {_pass_sql(2)}
SELECT id AS doc_id, size, source_size, target, CASE WHEN drawn THEN whole + 1 ELSE whole END * size AS taken FROM r3"""


@query("op2_mixing", _SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
