"""Deterministic comparison of expected and actual result tables, for all cases at once.

Every level groups by the *content* of rows, cells or columns together with the case, so one huge
case spreads over all tasks, and aggregates before it shuffles. Nothing is truncated: all rows of
both sides count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import canon
from concord.operators import results
from concord.operators.matching import paired_cases
from concord.session import PACKED, materialise, release

LEVELS = ("multiset", "set", "projection", "flat", "scaled", "tokens")


def weigh(coded: DataFrame) -> DataFrame:
    """Distinct rows per case with how often each side holds them: one shuffle on (case, row)."""
    return coded.groupBy("case_id", "codes").agg(
        F.count(F.when(F.col("side") == "expected", 1)).alias("n_e"),
        F.count(F.when(F.col("side") == "actual", 1)).alias("n_a"),
    )


def _differs() -> Column:
    return ((F.col("n_e") > 0) != (F.col("n_a") > 0)).cast("bigint")


def diffs(weighed: DataFrame) -> DataFrame:
    """Row differences per case, as multisets and as sets."""
    return weighed.groupBy("case_id").agg(
        F.sum(F.abs(F.col("n_e") - F.col("n_a"))).alias("diff_rows"),
        F.sum(_differs()).alias("diff_distinct"),
    )


def diff_multiset(coded: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other, per case; 0 means equal."""
    return diffs(weigh(coded)).select("case_id", "diff_rows")


def diff_set(coded: DataFrame) -> DataFrame:
    """Distinct rows that only one side holds, per case."""
    return diffs(weigh(coded)).select("case_id", F.col("diff_distinct").alias("diff_rows"))


def differing_rows(coded: DataFrame) -> DataFrame:
    """The differing rows themselves, with how often each side holds them."""
    return weigh(coded).filter(F.col("n_e") != F.col("n_a"))


# --- vectors ---------------------------------------------------------------------------------


def diff_flat(weighed: DataFrame) -> DataFrame:
    """Distinct values that only one side holds, ignoring rows and columns.

    Meant for cases in which one side is a vector, so that no row association is lost.
    """
    return (
        weighed.select("case_id", F.explode(F.array_distinct("codes")).alias("codes"), "n_e", "n_a")
        .groupBy("case_id", "codes")
        .agg(F.max("n_e").alias("n_e"), F.max("n_a").alias("n_a"))
        .groupBy("case_id")
        .agg(F.sum(_differs()).alias("diff_rows"))
    )


# --- tokens ----------------------------------------------------------------------------------


def _plain_number(units: str, digits: int) -> str:
    unit = 10**digits
    return (
        f"CASE WHEN {units} % {unit} = 0 THEN CAST({units} DIV {unit} AS STRING) "
        f"ELSE CAST({units} / {unit}D AS STRING) END"
    )


def row_tokens(codes: str, digits: int = 2) -> Column:
    """Lower-case words of a coded row, cell borders ignored; numbers in one plain form."""
    body = "substring(c, 2)"
    words = (
        f"CASE WHEN c = 'z' THEN '\\0' WHEN startswith(c, 'n') THEN "
        f"coalesce({_plain_number(f'try_cast({body} AS BIGINT)', digits)}, {body}) ELSE lower({body}) END"
    )
    split = f"split(array_join(transform({codes}, c -> {words}), ' '), r'\\s+')"
    units = f"({canon.round_units('try_cast(t AS DOUBLE)', digits)})"
    plain = f"CASE WHEN t RLIKE r'{canon.NUMBER}' THEN coalesce({_plain_number(units, digits)}, t) ELSE t END"
    return F.expr(f"transform(filter({split}, t -> t <> ''), t -> {plain})")


def diff_tokens(weighed: DataFrame, digits: int = 2) -> DataFrame:
    """Distinct token rows that only one side holds: ``Ann Lee`` against ``ann``, ``LEE``."""
    return (
        weighed.select("case_id", row_tokens("codes", digits).alias("codes"), "n_e", "n_a")
        .groupBy("case_id", "codes")
        .agg(F.max("n_e").alias("n_e"), F.max("n_a").alias("n_a"))
        .groupBy("case_id")
        .agg(F.sum(_differs()).alias("diff_rows"))
    )


# --- scale -----------------------------------------------------------------------------------


def _unpercent(cell: str) -> str:
    """A canonical cell with ``22.7%`` read as the number 22.7."""
    percent = f"{cell}.txt RLIKE r'{canon.PERCENT}'"
    number = f"try_cast(regexp_replace({cell}.txt, r'\\s*%$', '') AS DOUBLE)"
    return (
        f"named_struct('num', CASE WHEN {percent} THEN {number} ELSE {cell}.num END, "
        f"'txt', CASE WHEN {percent} THEN NULL ELSE {cell}.txt END)"
    )


def _decimals(x: str, digits: int) -> Column:
    """Decimal places a number shows, up to ``digits``."""
    tests = " ".join(
        f"WHEN abs({x} * {10**places}D - rint({x} * {10**places}D)) < 1e-6D THEN {places}" for places in range(digits)
    )
    return F.expr(f"CASE WHEN {x} IS NULL THEN NULL {tests} ELSE {digits} END")


def _plain_cells(rows: DataFrame) -> DataFrame:
    """``case_id, side, col_no, num, txt`` of every cell, percents read as numbers."""
    return (
        rows.select("case_id", "side", F.posexplode("cells").alias("col_no", "cell"))
        .select("case_id", "side", "col_no", F.expr(_unpercent("cell")).alias("cell"))
        .select("case_id", "side", "col_no", "cell.num", "cell.txt")
    )


def _column_stats(cells: DataFrame, digits: int) -> DataFrame:
    return cells.groupBy("case_id", "col_no", "side").agg(
        F.max(F.abs("num")).alias("top"),
        F.max(F.col("txt").isNotNull()).alias("text"),
        F.max(F.abs(F.col("num") - F.rint("num"))).alias("fraction"),
        F.max(_decimals("num", digits)).alias("plain_places"),
        F.max(_decimals("(num * 100D)", digits)).alias("raised_places"),
    )


def _raised(small: str, big: str) -> Column:
    """Whether two numeric columns are a factor of 100 apart, up to what rounding to their decimals leaves open."""
    top = lambda side: F.col(f"{side}_top")
    half = lambda side: F.pow(F.lit(10.0), -F.col(f"{side}_plain_places")) * 0.5
    numeric = (~F.col(f"{small}_text")) & (~F.col(f"{big}_text")) & (top(small) > 0) & (top(big) > 0)
    return numeric & (
        top(big).between(top(small) * 99.0, top(small) * 101.0)
        | ((top(big) >= top(small) * 50.0) & (F.abs(top(big) - top(small) * 100.0) <= half(small) * 100.0 + half(big)))
    )


def column_scales(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Per case: a factor for each column and side, and the decimals to compare at.

    A column is scaled only as a whole, when it is numeric throughout and its largest magnitudes
    are a factor of 100 apart, up to what rounding to the decimals they show leaves open (0.23 against 22.73);
    the smaller side is raised. A scaled column is compared at the precision of its coarser side, which is what
    rounding before or after scaling leaves.
    Result: ``case_id, e_factor, a_factor, places`` (arrays by column) and ``noisy``, the columns that may
    differ by rounding, largest numbers first.
    """
    per_side = _column_stats(_plain_cells(rows), digits)
    by_side = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side[0]}_{name}")
    names = ("top", "text", "fraction", "plain_places", "raised_places")
    both = per_side.groupBy("case_id", "col_no").agg(*[by_side(n, s) for n in names for s in results.SIDES])
    numeric = (~F.col("e_text")) & (~F.col("a_text")) & (F.col("e_top") > 0) & (F.col("a_top") > 0)
    raise_a, raise_e = _raised("a", "e"), _raised("e", "a")
    factors = both.select(
        "case_id", "col_no",
        F.when(raise_e, 100.0).otherwise(1.0).alias("e_factor"),
        F.when(raise_a, 100.0).otherwise(1.0).alias("a_factor"),
        F.when(raise_a, F.least("e_plain_places", "a_raised_places"))
        .when(raise_e, F.least("e_raised_places", "a_plain_places"))
        .otherwise(digits).alias("places"),
        ((raise_a | raise_e) | (numeric & (F.greatest("e_fraction", "a_fraction") > 0))).alias("noisy"),
        F.greatest("e_top", "a_top").alias("top"),
    )
    # Bounded group: the columns of one result table.
    arrays = factors.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("col_no", "e_factor", "a_factor", "places"))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("noisy"), F.struct((-F.col("top")).alias("size"), "col_no")))).alias("noisy"),
    )
    return arrays.select(
        "case_id", F.col("c.e_factor").alias("e_factor"), F.col("c.a_factor").alias("a_factor"),
        F.col("c.places").alias("places"), F.col("noisy.col_no").alias("noisy"),
    )


def _coarse_units(x: str, places: str, digits: int) -> str:
    """Units of a number rounded at so many places."""
    coarse = " ".join(f"WHEN {p} THEN ({canon.round_units(x, p)}) * {10 ** (digits - p)}" for p in range(digits))
    return f"CASE {places} {coarse} ELSE {canon.round_units(x, digits)} END"


def within_tolerance(values: DataFrame, tol: int = 1) -> DataFrame:
    """Whether two weighted multisets of integers agree in rank order within ``tol``, per group.

    ``values(case_id, grp, x, n_e, n_a)``. The k-th smallest values differ by at most ``tol``
    exactly when, on either side, the count up to ``y - tol`` never passes the other side's count
    up to ``y``. That is a running sum that must not fall below zero. It is taken inside the
    pieces of a range partitioning and carried over by one row per piece, so no group, however
    large, meets in one task and no pairs are formed. Returns ``case_id, ok``.
    """
    event = lambda test, x, w: F.struct(F.lit(test).alias("test"), x.alias("x"), w.alias("w"))
    x, n_e, n_a = F.col("x"), F.col("n_e"), F.col("n_a")
    events = (
        values.select(
            "case_id", "grp",
            F.explode(F.array(
                event("a", x, n_a), event("a", x + tol, -n_e), event("e", x, n_e), event("e", x + tol, -n_a)
            )).alias("v"),
        )
        .groupBy("case_id", "grp", "v.test", "v.x")
        .agg(F.sum("v.w").alias("w"))
    )
    keys = ["case_id", "grp", "test"]
    pieces = events.repartitionByRange(*keys, "x").withColumn("piece", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("run", F.sum("w").over(inside))
        .groupBy(*keys, "piece")
        .agg(F.min("run").alias("low"), F.sum("w").alias("total"))
        .withColumn("carried", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .groupBy("case_id", "grp", "test")
        .agg(F.min(F.col("low") + F.col("carried")).alias("low"), F.sum("total").alias("total"))
        .groupBy("case_id")
        .agg(F.min((F.col("low") >= 0) & (F.col("total") == 0)).alias("ok"))
    )


_SALTS = 32


def _of_cases(rows: DataFrame, cases: DataFrame, content: str | list[str], how: str = "inner") -> DataFrame:
    """Rows joined with a table of cases, dealt out by case and a salt of their content.

    The table of cases is repeated for each salt, so one case with a large share of all rows meets its record
    in many tasks; what groups the rows afterwards has to shuffle them by more than the case. ``cases`` should be read
    from a stored table: then its true size is known beforehand, and a small one goes to the rows, which are not shuffled.
    """
    content = [content] if isinstance(content, str) else content
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*content), F.lit(_SALTS)).cast("int"))
    spread = cases.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(spread, ["case_id", "_salt"], how).drop("_salt")


def diff_scaled(rows: DataFrame, digits: int = 2, tol: int = 1) -> DataFrame:
    """Differences left after percent signs and factors of 100 are evened out, per case.

    Works on canonical rows, since scaling must come before rounding. Where columns may carry rounding noise, a case is
    equal too if its rows pair up with these columns within ``tol`` units and the others equal: by rank where there
    is one such column, by matching where there are several. Returns ``case_id, diff_rows`` with 0 for equal.
    """
    scales = materialise(column_scales(rows, digits), "column-scales")
    joined = _of_cases(rows, scales.drop("noisy"), "cells").select(
        "case_id", "side", "places",
        F.expr(f"transform(cells, c -> {_unpercent('c')})").alias("cells"),
        F.expr("CASE WHEN side = 'expected' THEN e_factor ELSE a_factor END").alias("factor"),
    )
    scaled = joined.select(
        "case_id", "side", "places",
        F.expr("transform(cells, (c, i) -> struct(c.num * get(factor, i) AS num, c.txt AS txt))").alias("cells"),
    )
    units = _coarse_units("c.num", "get(places, i)", digits)
    text = "CASE WHEN c.num IS NOT NULL THEN concat('n~', CAST(c.num AS STRING)) ELSE coalesce(concat('t', c.txt), 'z') END"
    # A row is its numbers, as integers, and the codes of its other cells, which most rows of numbers do without: that is
    # far less to shuffle and to store than a text for each cell.
    coded = scaled.select("case_id", "side", "cells", F.expr(f"transform(cells, (c, i) -> CASE WHEN c.num IS NOT NULL THEN {units} END)").alias("units"))
    coded = coded.select("case_id", "side", "units", F.expr(
        f"CASE WHEN exists(units, u -> u IS NULL) THEN transform(cells, (c, i) -> CASE WHEN get(units, i) IS NULL THEN {text} END) END").alias("others"))
    weighed = materialise(
        coded.groupBy("case_id", "units", "others")
        .agg(
            F.count(F.when(F.col("side") == "expected", 1)).alias("n_e"),
            F.count(F.when(F.col("side") == "actual", 1)).alias("n_a"),
        ),
        "scaled-rows", **PACKED,
    )
    exact = materialise(diffs(weighed).select("case_id", F.col("diff_distinct").alias("diff_rows")), "scaled-diffs")
    open_cases = exact.filter("diff_rows > 0").select("case_id")
    if tol <= 0 or open_cases.isEmpty():
        release(weighed)
        return exact.select("case_id", F.col("diff_rows").cast("bigint").alias("diff_rows"))
    # Rows that agree take part too: another pairing of them can be what makes all rows pair up.
    open_cases = materialise(open_cases.join(scales.filter(F.size("noisy") > 0).select("case_id", "noisy"), "case_id"), "open-cases")
    loose = _of_cases(weighed, open_cases, ["units", "others"]).select(
        "case_id", "noisy",
        F.expr(
            "transform(units, (u, i) -> CASE WHEN u IS NULL THEN get(others, i) WHEN array_contains(noisy, i) THEN 'n' ELSE concat('n', CAST(u AS STRING)) END)"
        ).alias("grp"),
        F.expr("transform(noisy, i -> coalesce(get(units, i), 0L))").alias("xs"), "n_e", "n_a",
    )
    # A group that both sides hold alike pairs up by itself; groups are told apart by a hash, which may only keep too many.
    loose = loose.withColumn("h", F.xxhash64("case_id", "grp"))
    differing = materialise(loose.filter("n_e <> n_a").select("h").distinct(), "differing-groups")
    loose = loose.join(differing, "h", "left_semi").drop("h")
    near = open_cases.select("case_id").limit(0)
    if not open_cases.filter(F.size("noisy") == 1).isEmpty():
        one = loose.filter(F.size("noisy") == 1).select("case_id", "grp", F.get("xs", F.lit(0)).alias("x"), "n_e", "n_a")
        near = within_tolerance(one, tol).filter("ok").select("case_id")
    if not open_cases.filter(F.size("noisy") > 1).isEmpty():
        near = near.unionAll(paired_cases(loose.filter(F.size("noisy") > 1).drop("noisy"), tol, weighed=True))
    near = materialise(near.select("case_id", F.lit(True).alias("near")), "near-cases")
    release(weighed, differing)
    return exact.join(near, "case_id", "left").select(
        "case_id", F.when(F.col("near"), 0).otherwise(F.col("diff_rows")).cast("bigint").alias("diff_rows")
    )


# --- projection ------------------------------------------------------------------------------

_SEEDS = (11, 23, 47)
#: Of a case: partial maps that a round makes longer, rows of the wider side they are first held against, full maps
#: checked a round, rows that all its maps may be held against in a round, columns up to which pairs are looked at.
_BEAM, _WITNESSES, _CHECKED, _WORK, _PAIRED = 8192, 32, 32, 20_000_000, 24


def _sketch(value: Column) -> Column:
    """Smallest and largest hashes under several seeds.

    Equal sets always have equal sketches, duplicates never matter, and the size is constant, so
    columns can be matched after a map-side aggregation, without a shuffle of their values.
    """
    parts = [agg(F.xxhash64(value, F.lit(seed))) for seed in _SEEDS for agg in (F.min, F.max)]
    return F.array(*parts)


def _projection_rows(weighed: DataFrame) -> DataFrame:
    """Rows with the role of their side: ``n`` narrower, ``w`` wider (expected is narrow on a tie).

    Cases whose rows differ in width within a side are left out: they have no columns to map.
    """
    width = F.size("codes")
    on = lambda side, agg: agg(F.when(F.col(side) > 0, width))
    shapes = (
        weighed.groupBy("case_id")
        .agg(
            on("n_e", F.min).alias("e_lo"), on("n_e", F.max).alias("e_hi"),
            on("n_a", F.min).alias("a_lo"), on("n_a", F.max).alias("a_hi"),
        )
        .filter((F.col("e_lo") == F.col("e_hi")) & (F.col("a_lo") == F.col("a_hi")))
        .select("case_id", (F.col("e_hi") <= F.col("a_hi")).alias("expected_narrow"))
    )
    shapes = materialise(shapes, "projection-shapes")
    in_narrow = F.when(F.col("expected_narrow"), F.col("n_e") > 0).otherwise(F.col("n_a") > 0)
    in_wide = F.when(F.col("expected_narrow"), F.col("n_a") > 0).otherwise(F.col("n_e") > 0)
    roles = F.array_compact(F.array(F.when(in_narrow, F.lit("n")), F.when(in_wide, F.lit("w"))))
    return _of_cases(weighed, shapes, "codes").select("case_id", F.explode(roles).alias("role"), "codes")


def _column_plans(rows: DataFrame) -> DataFrame:
    """Per case, for each narrow column the wide columns it may map to.

    Columns that are equal row by row stand for each other, so only the first of them is mapped,
    with the condition that the wide side has at least as many copies. Narrow columns come
    fewest candidates first. Result: ``case_id, n_cols array<int>, choices array<array<int>>``;
    cases with an unmatched narrow column are dropped.
    """
    row_hash = F.xxhash64("codes")
    cells = rows.select("case_id", "role", row_hash.alias("h"), F.posexplode("codes").alias("col_no", "code"))
    bound, other = F.xxhash64("h", "code", F.lit(5)), F.xxhash64("code", F.lit(7), "h")
    columns = cells.groupBy("case_id", "role", "col_no").agg(
        _sketch(F.col("code")).alias("sketch"),
        F.array(F.bit_xor(bound), F.bit_xor(other), F.min(bound), F.max(other)).alias("twin"),
    )
    classes = columns.groupBy("case_id", "role", "sketch", "twin").agg(
        F.min("col_no").alias("col_no"), F.count("*").alias("copies")
    )
    classes = materialise(classes, "projection-columns")  # a row per column, read for both roles
    narrow = classes.filter("role = 'n'").select("case_id", "sketch", "col_no", "copies")
    wide = classes.filter("role = 'w'").select(
        "case_id", "sketch", F.col("col_no").alias("w_col"), F.col("copies").alias("w_copies")
    )
    candidates = (
        narrow.join(wide, ["case_id", "sketch"], "left")
        .groupBy("case_id", "col_no")
        .agg(F.sort_array(F.collect_list(F.when(F.col("w_copies") >= F.col("copies"), F.col("w_col")))).alias("to"))
    )
    # Bounded group: the columns of one result table.
    return (
        candidates.groupBy("case_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.size("to").alias("k"), "col_no", "to"))).alias("p"),
            F.min(F.size("to")).alias("fewest"),
        )
        .filter("fewest > 0")
        .select("case_id", F.col("p.col_no").alias("n_cols"), F.col("p.to").alias("choices"))
    )


def _pick(codes: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(codes, i))


def _verified(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Cases for which one of the full column maps gives equal sets of rows, checked exactly."""
    joined = _of_cases(rows, maps, "codes").select(
        "case_id", "to", "role",
        F.when(F.col("role") == "n", _pick(F.col("codes"), F.col("n_cols")))
        .otherwise(_pick(F.col("codes"), F.col("to"))).alias("codes"),
    )
    return (
        joined.groupBy("case_id", "to", "codes")
        .agg(F.max(F.col("role") == "n").alias("in_n"), F.max(F.col("role") == "w").alias("in_w"))
        .groupBy("case_id", "to")
        .agg(F.min(F.col("in_n") & F.col("in_w")).alias("equal"))
        .filter("equal")
        .select("case_id")
        .distinct()
    )


def _consistent(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with fewer choices: pairs of narrow columns must look like the pairs of wide columns they map to.

    A choice stays while for each other narrow column some choice has an equal sketch of value pairs, until
    nothing changes. Only tables of up to ``_PAIRED`` columns are looked at; others keep their choices. Plans that lose
    all choices of a column are dropped.
    """
    small = F.greatest(F.size("n_cols"), F.size(F.array_distinct(F.flatten("choices")))) <= _PAIRED
    held = plans.filter(small & (F.size("n_cols") > 1))
    if held.isEmpty():
        return plans
    positions = held.select("case_id", "n_cols", F.array_sort(F.array_distinct(F.flatten("choices"))).alias("w_cols"))
    joined = _of_cases(rows, positions, "codes").withColumn("at", F.when(F.col("role") == "n", F.col("n_cols")).otherwise(F.col("w_cols")))
    two = F.flatten(F.transform("at", lambda i: F.transform(
        F.filter("at", lambda j: i != j), lambda j: F.struct(i.alias("i"), j.alias("j"), F.xxhash64(F.get("codes", i), F.get("codes", j)).alias("v")))))
    pairs = joined.select("case_id", "role", F.explode(two).alias("p")).groupBy("case_id", "role", "p.i", "p.j").agg(_sketch(F.col("p.v")).alias("sketch"))
    pairs = materialise(pairs, "projection-pairs")
    options = held.select("case_id", F.explode(F.arrays_zip("n_cols", "choices")).alias("o")).select("case_id", F.col("o.n_cols").alias("i"), F.explode("o.choices").alias("a"))
    options = materialise(options, "projection-choices")
    other = options.select("case_id", F.col("i").alias("j"), F.col("a").alias("b"))
    like = (
        pairs.filter("role = 'n'").drop("role").join(pairs.filter("role = 'w'").select("case_id", F.col("i").alias("a"), F.col("j").alias("b"), "sketch"), ["case_id", "sketch"])
        .join(options, ["case_id", "i", "a"], "left_semi").join(other, ["case_id", "j", "b"], "left_semi").select("case_id", "i", "j", "a", "b")
    )
    like = materialise(like, "projection-alike")
    n_cols = held.select("case_id", (F.size("n_cols") - 1).alias("others"))
    count = -1
    while (left := options.count()) != count:
        count = left
        other = options.select("case_id", F.col("i").alias("j"), F.col("a").alias("b"))
        met = like.join(other, ["case_id", "j", "b"], "left_semi").groupBy("case_id", "i", "a").agg(F.count_distinct("j").alias("n"))
        options = materialise(
            options.join(met, ["case_id", "i", "a"]).join(n_cols, "case_id").filter("n = others").select("case_id", "i", "a"), "projection-choices"
        )
    fewer = options.groupBy("case_id", "i").agg(F.sort_array(F.collect_list("a")).alias("to")).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct(F.size("to").alias("k"), F.col("i").alias("col_no"), "to"))).alias("p")
    )
    fewer = fewer.join(n_cols, "case_id").filter(F.size("p") == F.col("others") + 1)
    fewer = fewer.select("case_id", F.col("p.col_no").alias("n_cols"), F.col("p.to").alias("choices"))
    return materialise(plans.join(held.select("case_id"), "case_id", "left_anti").unionByName(fewer), "projection-plans")


def _search_maps(rows: DataFrame, plans: DataFrame, forms: int = 1) -> DataFrame:
    """Cases with several possible column maps: depth-first search, all cases in step, a depth a round.

    A round makes up to ``_BEAM`` of the deepest partial maps of every open case longer by one column. New maps are held
    against a few rows of the wider side, whose values under the map must occur on the narrower; as far as
    ``_WORK`` reaches, those left against sketches of all rows. Full maps are checked exactly, ``_CHECKED`` a round. Maps
    that wait stay in the frontier, so the work of a round is bounded while no map is ever skipped. Positions that
    agree in whole ``forms`` are forms of one column, of which a map takes one.
    """
    spark = rows.sparkSession
    rows = materialise(_of_cases(rows, plans.select("case_id"), "codes", "left_semi"), "projection-rows")
    depth = F.explode(F.sequence(F.lit(1), F.size("n_cols"))).alias("depth")
    begun = _of_cases(rows.filter("role = 'n'"), plans.select("case_id", "n_cols"), "codes").select("case_id", depth, "n_cols", "codes")
    begun = begun.select("case_id", "depth", F.xxhash64(_pick(F.col("codes"), F.slice("n_cols", F.lit(1), F.col("depth")))).alias("h")).distinct()
    begun = materialise(begun, "projection-beginnings")
    prefixes = materialise(begun.groupBy("case_id", "depth").agg(_sketch(F.col("h")).alias("sketch")), "projection-prefixes")
    wide = rows.filter("role = 'w'")
    by_hash = Window.partitionBy("case_id").orderBy(F.xxhash64("codes"), "codes")
    witnesses = wide.withColumn("nr", F.row_number().over(by_hash)).filter(F.col("nr") <= _WITNESSES).groupBy("case_id").agg(F.collect_list("codes").alias("witnesses"))
    sizes = wide.groupBy("case_id").agg(F.count("*").alias("n_rows"))
    plans = materialise(plans.join(witnesses, "case_id").join(sizes, "case_id"), "projection-open")
    maps = plans.select("case_id", "n_cols", F.array().cast("array<int>").alias("to"))
    found = spark.createDataFrame([], "case_id string")
    deepest = Window.partitionBy("case_id").orderBy(F.size("to").desc(), F.col("to"))
    full = F.size("to") == F.size("n_cols")
    while True:
        ranked = maps.withColumn("rank", F.row_number().over(deepest))
        grown = (
            ranked.filter((F.col("rank") <= _BEAM) & ~full).drop("n_cols").join(plans, "case_id")
            .select("case_id", "n_cols", "n_rows", "witnesses", "to", F.explode(F.get("choices", F.size("to"))).alias("next"))
            .filter(~F.exists("to", lambda x: F.floor(x / forms) == F.floor(F.col("next") / forms)))
            .select("case_id", "n_cols", "n_rows", "witnesses", F.array_append("to", F.col("next")).alias("to"))
        )
        shown = F.explode(F.transform("witnesses", lambda c: F.xxhash64(F.transform(F.col("to"), lambda i: F.get(c, i))))).alias("h")
        refuted = grown.select("case_id", "to", F.size("to").alias("depth"), shown).join(begun, ["case_id", "depth", "h"], "left_anti").select("case_id", "to").distinct()
        grown = materialise(grown.drop("witnesses").join(refuted, ["case_id", "to"], "left_anti"), "projection-grown")
        tested = grown.groupBy("case_id").agg(F.collect_list("to").alias("maps"), F.max("n_rows").alias("n_rows")).filter(F.size("maps") * F.col("n_rows") <= _WORK)
        sketched = (
            _of_cases(wide, tested.select("case_id", "maps"), "codes")
            .select("case_id", F.explode("maps").alias("to"), "codes")
            .groupBy("case_id", "to")
            .agg(_sketch(F.xxhash64(_pick(F.col("codes"), F.col("to")))).alias("sketch"))
            .withColumn("depth", F.size("to"))
            .join(prefixes, ["case_id", "depth", "sketch"], "left_semi")
        )
        kept = grown.join(sketched.select("case_id", "to"), ["case_id", "to"], "left_semi").unionByName(grown.join(tested, "case_id", "left_anti"))
        waiting = ranked.filter((F.col("rank") > _BEAM) | full).select("case_id", "n_cols", "to")
        maps = materialise(kept.select("case_id", "n_cols", "to").unionByName(waiting), "projection-frontier")
        ready = maps.filter(full).withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("to"))).filter(F.col("rank") <= _CHECKED).drop("rank")
        ready = materialise(ready, "projection-full")
        if not ready.isEmpty():
            found = materialise(found.union(_verified(rows, ready)), "projection-found")
            maps = maps.join(ready.select("case_id", "to"), ["case_id", "to"], "left_anti")
        maps = maps.join(found, "case_id", "left_anti")
        if maps.isEmpty():
            return found


def match_projection(weighed: DataFrame) -> DataFrame:
    """Cases in which the narrower side equals, as a set of rows, some columns of the wider one.

    A reordering of all columns counts as well. Returns ``case_id``.
    """
    rows = _projection_rows(weighed)
    return _mapped(rows, materialise(_column_plans(rows), "projection-plans"))


def _mapped(rows: DataFrame, plans: DataFrame, forms: int = 1) -> DataFrame:
    """Cases for which some choice of the plans gives equal sets of rows."""
    single = F.forall("choices", lambda c: F.size(c) == 1)
    straight = plans.filter(single).select(
        "case_id", "n_cols", F.transform("choices", lambda c: c[0]).alias("to")
    )
    columns = F.array_distinct(F.transform("to", lambda x: F.floor(x / forms)))
    found = _verified(rows, straight.filter(F.size(columns) == F.size("to")))
    open_plans = plans.filter(~single)
    if open_plans.isEmpty():
        return found
    open_plans = _consistent(rows, open_plans)
    if open_plans.isEmpty():
        return found
    return found.union(_search_maps(rows, open_plans, forms))


def match_scaled_projection(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Cases in which the narrower side equals, as a set of rows, some columns of the wider one after scaling.

    Works on canonical rows of sides of different widths. Every column is coded in several forms: plain and raised by
    100, each at every number of decimals. For each two columns their magnitudes say which forms to compare, as in
    ``column_scales``, and sketches of these whether they can be the same. A narrow column that fits some column unscaled is taken
    unscaled. Values are equal after rounding; there is no further tolerance. Returns ``case_id``.
    """
    forms = 2 * (digits + 1)
    width = rows.groupBy("case_id", "side").agg(F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high"))
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    widths = width.groupBy("case_id").agg(side("expected", "low").alias("e"), side("actual", "low").alias("a"), F.max(F.col("low") != F.col("high")).alias("ragged"))
    widths = widths.filter("NOT ragged AND e <> a").select("case_id", F.when(F.col("e") < F.col("a"), "expected").otherwise("actual").alias("narrow"))
    widths = materialise(widths, "scaled-widths")
    own = _of_cases(rows, widths, "cells").withColumn("role", F.when(F.col("side") == F.col("narrow"), "n").otherwise("w"))
    own = own.select("case_id", "role", F.expr(f"transform(cells, c -> {_unpercent('c')})").alias("cells"))
    form = lambda f, p: (
        f"CASE WHEN c.num IS NOT NULL THEN concat('n', coalesce(CAST({_coarse_units(f'(c.num * {f}D)', str(p), digits)} AS STRING), "
        f"concat('~', CAST(c.num * {f}D AS STRING)))) ELSE coalesce(concat('t', c.txt), 'z') END"
    )
    every = ", ".join(form(f, p) for f in (1, 100) for p in range(digits + 1))
    coded = own.select("case_id", "role", "cells", F.expr(f"flatten(transform(cells, c -> array({every})))").alias("codes"))
    coded = materialise(coded.groupBy("case_id", "role", "codes").agg(F.min("cells").alias("cells")), "scaled-forms")
    if coded.isEmpty():
        return coded.select("case_id")
    cells = coded.select("case_id", F.col("role").alias("side"), F.posexplode("cells").alias("col_no", "cell")).select("case_id", "side", "col_no", "cell.num", "cell.txt")
    stats = _column_stats(cells, digits)
    prints = coded.select("case_id", F.col("role").alias("side"), F.posexplode("codes").alias("at", "code")).groupBy("case_id", "side", "at").agg(_sketch(F.col("code")).alias("sketch"))
    prints = prints.groupBy("case_id", "side", F.floor(F.col("at") / forms).cast("int").alias("col_no")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "sketch"))), lambda x: x["sketch"]).alias("sketches")
    )
    columns = materialise(stats.join(prints, ["case_id", "side", "col_no"]), "scaled-columns")
    of = lambda role: columns.filter(F.col("side") == role).select("case_id", *[F.col(c).alias(f"{role}_{c}") for c in ("col_no", "top", "text", "plain_places", "raised_places", "sketches")])
    two = of("n").join(of("w"), "case_id")  # bounded group: the columns of one case
    up_n, up_w = _raised("n", "w"), _raised("w", "n")
    places = (
        F.when(up_n, F.least("n_raised_places", "w_plain_places")).when(up_w, F.least("n_plain_places", "w_raised_places")).otherwise(digits)
    )
    two = two.withColumns({"n_form": places + F.when(up_n, digits + 1).otherwise(0), "w_form": places + F.when(up_w, digits + 1).otherwise(0), "scaled": up_n | up_w})
    met = two.filter(F.get("n_sketches", F.col("n_form")) == F.get("w_sketches", F.col("w_form")))
    best = F.min(F.struct("scaled", "n_form")).over(Window.partitionBy("case_id", "n_col_no"))
    met = met.withColumn("best", best).filter((F.col("scaled") == F.col("best.scaled")) & (F.col("n_form") == F.col("best.n_form")))
    at = lambda role: (F.col(f"{role}_col_no") * forms + F.col(f"{role}_form")).cast("int")
    choices = met.select("case_id", at("n").alias("col_no"), at("w").alias("to")).groupBy("case_id", "col_no").agg(F.sort_array(F.collect_set("to")).alias("to"))
    needed = columns.filter("side = 'n'").groupBy("case_id").agg(F.count("*").alias("needed"))
    plans = choices.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.size("to").alias("k"), "col_no", "to"))).alias("p")).join(needed, "case_id")
    plans = plans.filter(F.size("p") == F.col("needed")).select("case_id", F.col("p.col_no").alias("n_cols"), F.col("p.to").alias("choices"))
    return _mapped(coded.select("case_id", "role", "codes"), materialise(plans, "projection-plans"), forms)


# --- cascade ---------------------------------------------------------------------------------


def _case_shapes(sides: DataFrame) -> DataFrame:
    pick = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side[0]}_{name}")
    return sides.groupBy("case_id").agg(
        *[pick(n, s) for n in ("n_rows", "n_cols", "status") for s in results.SIDES]
    )


def verdicts(rows: DataFrame, sides: DataFrame, profile: str = "strict", digits: int = 2) -> DataFrame:
    """One verdict per case: ``case_id, res, level, diff_rows, error``.

    ``rows`` are canonical rows of the same profile. ``strict`` decides by multiset equality alone.
    ``lenient`` goes on through the levels, each on the cases the earlier ones left open. Two
    empty sides are equal; a missing or failed side never is, nor are rows without a case, which have one record. ``diff_rows`` always counts the
    multiset difference; ``level`` names the level that found equality, or ``none``.
    """
    coded = results.coded(rows, digits)
    return _verdicts(coded, rows, sides, profile, digits)


def verdicts_from_coded(coded: DataFrame, sides: DataFrame) -> DataFrame:
    """Strict verdicts from coded rows."""
    return _verdicts(coded, None, sides, "strict", 2)


def _verdicts(coded: DataFrame, rows: DataFrame | None, sides: DataFrame, profile: str, digits: int) -> DataFrame:
    shapes = _case_shapes(sides)
    side_error = reduce(
        lambda acc, s: F.when(F.col(f"{s[0]}_status").isNull(), f"{s} side absent")
        .when(F.col(f"{s[0]}_status") != "ok", F.concat(F.lit(f"{s} side "), F.col(f"{s[0]}_status")))
        .otherwise(acc),
        results.SIDES,
        F.lit(None).cast("string"),
    )
    e_empty, a_empty = F.col("e_n_rows") == 0, F.col("a_n_rows") == 0
    if profile == "lenient":
        nulls = results.single_null_sides(rows, sides)
        flags = nulls.groupBy("case_id").agg(
            F.max(F.col("side") == "expected").alias("e_null"), F.max(F.col("side") == "actual").alias("a_null")
        )
        shapes = shapes.join(flags, "case_id", "left")
        e_empty = e_empty | F.coalesce("e_null", F.lit(False))
        a_empty = a_empty | F.coalesce("a_null", F.lit(False))
    weighed = weigh(coded)
    if profile == "lenient":
        weighed = materialise(weighed, "verdict-rows")  # every later level reads them again
    counted = diffs(weighed)
    # A case with rows but no side record is a verdict too: both its sides are absent.
    counted = counted.withColumnRenamed("case_id", "counted_id")
    base = shapes.join(counted, F.col("case_id").eqNullSafe(F.col("counted_id")), "full").withColumn(
        "case_id", F.coalesce("case_id", "counted_id")
    ).select(
        "case_id", "e_n_rows", "a_n_rows", "e_n_cols", "a_n_cols",
        F.when(F.col("case_id").isNull(), "rows without a case").otherwise(side_error).alias("error"),
        F.coalesce("diff_rows", F.lit(0).cast("bigint")).alias("diff_rows"),
        F.coalesce("diff_distinct", F.lit(0).cast("bigint")).alias("diff_distinct"),
        F.coalesce(e_empty & a_empty, F.lit(False)).alias("both_empty"),
        F.coalesce(e_empty | a_empty, F.lit(False)).alias("one_empty"),
    )
    first = (
        F.when(F.col("error").isNotNull(), "none")
        .when(F.col("both_empty"), "empty")
        .when(F.col("diff_rows") == 0, "multiset")
    )
    if profile == "strict":
        return _verdict_columns(base.withColumn("level", F.coalesce(first, F.lit("none"))))

    first = first.when(F.col("one_empty"), "none").when(F.col("diff_distinct") == 0, "set")
    base = materialise(base.withColumn("level", first), "verdict-base")
    is_open = base.filter(F.col("level").isNull()).select("case_id", "e_n_rows", "a_n_rows", "e_n_cols", "a_n_cols")
    if is_open.isEmpty():
        return _verdict_columns(base)
    found = []
    for level in LEVELS[2:]:
        if level == "projection":
            hits = match_projection(_only(weighed, is_open))
        elif level == "flat":
            vector = (F.least("e_n_rows", "a_n_rows") == 1) | (F.least("e_n_cols", "a_n_cols") == 1)
            hits = diff_flat(_only(weighed, is_open.filter(vector))).filter("diff_rows = 0").select("case_id")
        elif level == "scaled":
            hits = (
                diff_scaled(_only(rows, is_open.filter("e_n_cols = a_n_cols"), "cells"), digits)
                .filter("diff_rows = 0").select("case_id")
            )
            uneven = is_open.filter("e_n_cols <> a_n_cols")
            if not uneven.isEmpty():
                hits = hits.union(match_scaled_projection(_only(rows, uneven, "cells"), digits))
        else:
            hits = diff_tokens(_only(weighed, is_open), digits).filter("diff_rows = 0").select("case_id")
        hits = materialise(hits.select("case_id", F.lit(level).alias("found")), f"verdict-{level}")
        found.append(hits)
        is_open = is_open.join(hits, "case_id", "left_anti")
    all_found = reduce(DataFrame.unionByName, found)
    joined = base.join(all_found, "case_id", "left")
    return _verdict_columns(joined.withColumn("level", F.coalesce("level", "found", F.lit("none"))))


def _only(frame: DataFrame, cases: DataFrame, content: str = "codes") -> DataFrame:
    return _of_cases(frame, cases.select("case_id"), content, "left_semi")


def _verdict_columns(base: DataFrame) -> DataFrame:
    return base.select(
        "case_id", (F.col("level") != "none").cast("int").alias("res"), "level", "diff_rows", "error"
    )
