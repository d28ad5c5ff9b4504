"""Golden pairs for the comparison rules, and properties of the verdict."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from concord import session
from concord.functions import canon
from concord.operators import matching, parity, results
from concord.operators.matching import paired_cases
from concord.session import materialise

# rule, expected, actual that is equal, actual that is not, level that decides
PAIRS = [
    ("numeric form", [[4]], [["4.0"]], [["4.5"]], "multiset"),
    ("order", [[1], [2], [3]], [[3], [1], [2]], [[3], [1], [1]], "multiset"),
    ("percent of a rounded share", [[0.23]], [["22.73%"]], [["24.1%"]], "scaled"),
    ("percent of a small share", [[0.05]], [["5.12%"]], [["5.9%"]], "scaled"),
    ("nesting", ["p", "q"], [[["p"], ["q"]]], [["p"]], "flat"),
    ("list as text", ["p", "q"], "['q','p']", "['q']", "multiset"),
    ("white space", [["oak tree"]], [[" oak tree\n"]], [["oaktree"]], "multiset"),
    ("single item", [["fig"]], "fig", "figs", "multiset"),
    ("labels", [[10], [20]], [["a", 10], ["b", 20]], [["a", 10], ["b", 21]], "projection"),
    ("extra columns", [["a", 1], ["b", 2]], [["a", "x", 1], ["b", "y", 2]], [["a", "x", 2], ["b", "y", 1]], "projection"),
    ("duplicates", [[1], [2]], [[1], [2], [2]], [[1], [2], [3]], "set"),
    ("orientation", [[1], [2], [3]], [[1, 2, 3]], [[1, 2, 4]], "flat"),
    ("booleans", [[True]], [["Yes"]], [["no"]], "multiset"),
    ("names", [["Ann Lee"]], [["ann", "LEE"]], [["Ann", "Low"]], "tokens"),
    ("scale", [[0.25]], [["25%"]], [["26%"]], "scaled"),
    ("scale, rounded", [["a", 0.227], ["b", 0.5]], [["a", 22.73], ["b", 50.0]], [["a", 22.93], ["b", 50.0]], "scaled"),
    ("rounding edge", [["a", 1.004], ["b", 7.31]], [["a", 1.0051], ["b", 7.31]], [["a", 1.03], ["b", 7.31]], "scaled"),
    ("time and null", [["7:05"], [None]], [["07:05:00"], ["NaN"]], [["07:50:00"], ["NaN"]], "multiset"),
    ("no partial", [[1], [2], [3]], None, [[1], [2]], None),
    ("association", [["a", 1], ["b", 2]], None, [["a", 2], ["b", 1]], None),
    ("long table", [[i, f"r{i}"] for i in range(40)], [[i, f"r{i}"] for i in reversed(range(40))],
     [[i, f"r{i}" if i < 39 else "other"] for i in range(40)], "multiset"),
    ("column order", [["a", 1], ["b", 2]], [[1, "a"], [2, "b"]], [[1, "b"], [2, "a"]], "projection"),
    ("twin columns", [["a", "a", 1], ["b", "b", 2]], [[1, "a", "a", None, None], [2, "b", "b", None, None]],
     [[1, "a", "c", None, None], [2, "b", "d", None, None]], "projection"),
    ("flags", [[0, 1, 0], [1, 0, 0], [1, 1, 1]], [[9, 1, 0, 0], [8, 0, 1, 0], [7, 1, 1, 1]],
     [[9, 1, 0, 0], [8, 0, 1, 1], [7, 1, 1, 0], [6, 0, 0, 0]], "projection"),
    ("empty", [], [], None, "empty"),
]


def judge(spark, pairs, profile):
    """Verdicts of ``{case: (expected, actual)}``; the values are stored as JSON."""
    df = spark.createDataFrame(
        [(k, json.dumps(e), json.dumps(a)) for k, (e, a) in pairs.items()], "case_id string, e string, a string"
    )
    e_rows, e_sides = results.rows_from_json(df, "case_id", "expected", "e", profile)
    a_rows, a_sides = results.rows_from_json(df, "case_id", "actual", "a", profile)
    rows, sides = materialise(e_rows.union(a_rows), "rows"), materialise(e_sides.union(a_sides), "sides")
    out = parity.verdicts(rows, sides, profile)
    return {r.case_id: r for r in out.collect()}


@pytest.fixture(scope="module")
def golden():
    pairs, want = {}, {}
    for rule, expected, equal, unequal, level in PAIRS:
        if equal is not None:
            pairs[f"{rule}/equal"], want[f"{rule}/equal"] = (expected, equal), (1, level)
        if unequal is not None:
            pairs[f"{rule}/unequal"], want[f"{rule}/unequal"] = (expected, unequal), (0, "none")
    return pairs, want


def test_golden_lenient(spark, golden):
    pairs, want = golden
    got = judge(spark, pairs, "lenient")
    assert {k: (r.res, r.level) for k, r in got.items()} == want


def test_golden_is_symmetric(spark, golden):
    pairs, want = golden
    got = judge(spark, {k: (a, e) for k, (e, a) in pairs.items()}, "lenient")
    assert {k: (r.res, r.level) for k, r in got.items()} == want


def test_golden_strict(spark, golden):
    pairs, want = golden
    got = judge(spark, pairs, "strict")
    lenient_only = {"booleans/equal", "time and null/equal"}
    for k, (res, level) in want.items():
        expected = res if level in ("multiset", "empty") and k not in lenient_only else 0
        assert got[k].res == expected, k


def test_missing_and_failed_sides(spark):
    rows = spark.createDataFrame([], results.ROWS_SCHEMA)
    sides = spark.createDataFrame(
        [("a", "expected", 0, 0, "ok"), ("a", "actual", 0, 0, "failed"), ("b", "expected", 0, 0, "ok"),
         ("c", "expected", 0, 0, "missing"), ("c", "actual", 0, 0, "ok")],
        results.SIDES_SCHEMA,
    )
    for profile in ("strict", "lenient"):
        got = {r.case_id: r for r in parity.verdicts(rows, sides, profile).collect()}
        assert all(r.res == 0 and r.error for r in got.values()) and len(got) == 3


def test_properties(spark):
    rng = random.Random(7)
    pairs, want = {}, {}
    for n in range(12):
        table = [[rng.randint(0, 5), rng.choice("abc"), round(rng.random(), 3) * 10] for _ in range(rng.randint(2, 60))]
        shuffled = rng.sample(table, len(table))
        unique = [list(r) for r in {tuple(r) for r in table}]
        pairs[f"shuffled{n}"], want[f"shuffled{n}"] = (table, shuffled), "multiset"
        pairs[f"doubled{n}"], want[f"doubled{n}"] = (table, table + table), "set"
        pairs[f"dropped{n}"], want[f"dropped{n}"] = (unique, unique[1:]), "none"
    got = judge(spark, pairs, "lenient")
    assert {k: r.level for k, r in got.items()} == want


def brute_projection(e, a):
    from itertools import permutations

    narrow, wide = (e, a) if len(e[0]) <= len(a[0]) else (a, e)
    target = {tuple(r) for r in narrow}
    return any(
        {tuple(r[i] for i in m) for r in wide} == target
        for m in permutations(range(len(wide[0])), len(narrow[0]))
    )


@pytest.mark.parametrize("limits", [{"_BEAM": 2, "_CHECKED": 1, "_WORK": 0, "_PAIRED": 0}, {"_BEAM": 3}])
def test_projection_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(parity, name, value)
    rng = random.Random(3)
    pairs = {}
    for n in range(40):
        q, p = rng.randint(2, 5), 0
        p = rng.randint(1, q)
        wide = [[rng.randint(0, 1 + n % 2) for _ in range(q)] for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.3:
            wide = [r + [r[0]] for r in wide]
        cols = rng.sample(range(len(wide[0])), p)
        narrow = [[r[i] for i in cols] for r in wide]
        if rng.random() < 0.5:
            narrow[rng.randrange(len(narrow))][rng.randrange(p)] = rng.randint(0, 1)
        pairs[str(n)] = (narrow, wide) if n % 3 else (wide, narrow)
    df = spark.createDataFrame(
        [(k, json.dumps(e), json.dumps(a)) for k, (e, a) in pairs.items()], "case_id string, e string, a string"
    )
    e_rows, _ = results.rows_from_json(df, "case_id", "expected", "e")
    a_rows, _ = results.rows_from_json(df, "case_id", "actual", "a")
    weighed = parity.weigh(results.coded(e_rows.union(a_rows)))
    got = {r.case_id for r in parity.match_projection(weighed).collect()}
    assert got == {k for k, (e, a) in pairs.items() if brute_projection(e, a)}


def flags(rng, rows, columns, density=0.5):
    return [[int(rng.random() < density) for _ in range(columns)] for _ in range(rows)]


def coded_pair(spark, pairs):
    rows = [(k, side, [f"n{v}" for v in r]) for k, both in pairs.items() for side, t in zip(results.SIDES, both) for r in t]
    return parity.weigh(spark.createDataFrame(rows, "case_id string, side string, codes array<string>"))


def test_projection_of_flag_columns(spark):
    """Six flags against ten, all values 0 or 1: no map, one map, and every map."""
    rng = random.Random(9)
    wide = flags(rng, 600, 10)
    narrow = [list(r) for r in {tuple(r) for r in flags(rng, 400, 6)}][:40]
    source = flags(rng, 90, 10, 0.3)
    one = [[r[i] for i in (7, 2, 9, 0, 4, 1)] for r in source]
    every = [[i >> b & 1 for b in range(6)] for i in range(64)]
    weighed = coded_pair(spark, {"none": (narrow, wide), "one": (one, source), "every": (every, flags(rng, 3000, 10))})
    context = spark.sparkContext
    context.setJobGroup("flags", "flags")
    got = {r.case_id for r in parity.match_projection(weighed).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    print("jobs", len(context.statusTracker().getJobIdsForGroup("flags")))
    assert got == {"one", "every"}


def test_tolerance_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for n in range(60):
        k = rng.randint(1, 30)
        a = [rng.randint(0, 40) for _ in range(k)]
        b = [v + rng.choice((-1, 0, 1, 1)) for v in a] if n % 2 else [rng.randint(0, 40) for _ in range(k)]
        if n % 7 == 0:
            b = b[1:] + [b[0] + 2]
        want[str(n)] = all(abs(x - y) <= 1 for x, y in zip(sorted(a), sorted(b)))
        rows += [(str(n), "g", v, 1, 0) for v in a] + [(str(n), "g", v, 0, 1) for v in b]
    df = spark.createDataFrame(rows, "case_id string, grp string, x bigint, n_e bigint, n_a bigint").repartition(4)
    got = {r.case_id: r.ok for r in parity.within_tolerance(df).collect()}
    assert got == want


COLLECTIONS = [
    ("['a (b)', 'c']", ["a (b)", "c"]), ("['x True y', True]", ["x True y", True]), ('["it\'s", \'c\']', ["it's", "c"]),
    ("['say \"hi\"', 'c']", ['say "hi"', "c"]), ("('a, ]', None, )", ["a, ]", None]), ("['it\\'s']", ["it's"]), ("{'k': (1, False)}", {"k": [1, False]}),
]


def test_collections_keep_what_is_inside_strings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(COLLECTIONS)], "i int, t string")
    got = {r.i: json.loads(r.j) for r in df.selectExpr("i", f"to_json({canon.parse_collection('t')}) AS j").collect()}
    assert got == {i: v for i, (_, v) in enumerate(COLLECTIONS)}
    odd = spark.createDataFrame([("['open]",), ("[1] 'x",), ("plain",)], "t string")
    assert odd.selectExpr(f"{canon.parse_collection('t')} AS v").filter("v IS NOT NULL").count() == 0


def test_collections_as_cells(spark):
    pairs = {str(i): (v, t) for i, (t, v) in enumerate(COLLECTIONS)}
    assert {r.res for r in judge(spark, pairs, "lenient").values()} == {1}


@pytest.mark.parametrize("profile", ["strict", "lenient"])
def test_rows_without_a_side_record_get_a_verdict(spark, profile):
    df = spark.createDataFrame([("a", "[[1]]"), ("b", "[[1]]")], "case_id string, v string")
    one = [results.rows_from_json(df, "case_id", s, "v", profile) for s in ("expected", "actual")]
    rows, sides = one[0][0].union(one[1][0]), one[0][1].union(one[1][1]).filter("case_id = 'a'")
    got = {r.case_id: (r.res, r.error is None) for r in parity.verdicts(materialise(rows, "rows"), materialise(sides, "sides"), profile).collect()}
    assert got == {"a": (1, True), "b": (0, False)}


def test_a_hot_case_is_dealt_out_by_content(spark):
    """Without broadcasts, every join with cases is dealt by more than the case, and so is what groups after it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).selectExpr("'hot' AS case_id", "array(CAST(id AS STRING)) AS codes", "'expected' AS side")
        cases = spark.createDataFrame([("hot",)], "case_id string")
        grouped = parity._of_cases(rows, cases, "codes", "left_semi").groupBy("case_id", "codes").count()
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 3 and all("codes" in x or "_salt" in x for x in exchanges)
        held = parity._of_cases(rows, cases, "codes").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in held) < 700 and sum(r["count"] for r in held) == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_noise_in_several_columns(spark):
    base = [[f"r{i}", i + 1.004, 50 - i + 2.004] for i in range(12)]
    noisy = [[k, x + 0.0011, y + 0.0011 * (i % 2)] for i, (k, x, y) in enumerate(base)]
    crossed = [[k, x + 0.0011, noisy[i - 1][2]] for i, (k, x, _) in enumerate(base)]
    bare, bare_noisy, bare_crossed = ([r[1:] for r in t] for t in (base, noisy, crossed))
    share = [[r[0], f"{r[1]}%", r[2]] for r in base], [[r[0], (r[1] + 0.0011) / 100, r[2] + 0.0011] for r in base]
    pairs = {"noisy": (base, noisy[::-1]), "crossed": (base, crossed), "bare": (bare, bare_noisy), "bare, crossed": (bare, bare_crossed), "percent": share}
    got = {k: (r.res, r.level) for k, r in judge(spark, pairs, "lenient").items()}
    no = (0, "none")
    assert got == {"noisy": (1, "scaled"), "crossed": no, "bare": (1, "scaled"), "bare, crossed": no, "percent": (1, "scaled")}


def paired(a, b):
    """Whether the rows pair up with all numbers within one, by augmenting paths over single rows."""
    owner = {}

    def place(i, seen):
        for j, y in enumerate(b):
            if j not in seen and all(abs(p - q) <= 1 for p, q in zip(a[i], y)):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return len(a) == len(b) and all(place(i, set()) for i in range(len(a)))


def test_pairing_against_matching(spark):
    """Sparse and dense numbers in two and three columns, repeated rows, rows that only fit if others give way."""
    rng = random.Random(6)
    rows, want = [], {}
    for n in range(120):
        top, width = (4000, 4, 9, 14)[n % 4], 2 + (n % 8 > 4)
        a = [tuple(rng.randint(0, top) for _ in range(width)) for _ in range(rng.randint(1, 18))]
        a += rng.choices(a, k=rng.randrange(4))
        b = [tuple(v + rng.choice((-1, 0, 1)) for v in x) for x in a]
        if n % 3 == 0:
            b = list(zip([x[0] for x in b], *[[y[k] for y in b[1:] + b[:1]] for k in range(1, width)]))
        if n % 5 == 0:
            b[0] = tuple(v + 2 for v in b[0])
        want[str(n)] = paired(a, b)
        rows += [(str(n), ["n", f"g{n % 2}"], list(x), 1, 0) for x in a] + [(str(n), ["n", f"g{n % 2}"], list(x), 0, 1) for x in b]
    # a chain in which each row has to give way to the next, both ends in one column
    chain = [(i, 7) for i in range(9)]
    rows += [("chain", ["n"], list(x), 1, 0) for x in chain] + [("chain", ["n"], [x + 1, y], 0, 1) for x, y in chain]
    rows += [("half chain", ["n"], [i, i % 2], 1, 0) for i in range(8)] + [("half chain", ["n"], [i + (i > 3), i % 2], 0, 1) for i in range(8)]
    want |= {"chain": True, "half chain": paired([(i, i % 2) for i in range(8)], [(i + (i > 3), i % 2) for i in range(8)])}
    rows += [("groups", ["x"], [1, 1], 1, 0), ("groups", ["y"], [1, 1], 0, 1)]
    want["groups"] = False
    df = spark.createDataFrame(rows, "case_id string, grp array<string>, xs array<bigint>, n_e bigint, n_a bigint").repartition(4)
    got = {r.case_id for r in paired_cases(df).collect()}
    assert got == {k for k, ok in want.items() if ok} and 20 < len(got) < 110


def brute_scaled(e, a):
    """Whether some columns of the wider table, each as it is or a factor of 100 apart as a whole, give the rows of the other."""
    from itertools import permutations

    narrow, wide = (e, a) if len(e[0]) < len(a[0]) else (a, e)

    def read(v):
        return float(v[:-1]) if isinstance(v, str) and v.endswith("%") else v

    def forms(column_n, column_w):
        n, w = [read(v) for v in column_n], [read(v) for v in column_w]
        if all(isinstance(v, (int, float)) for v in n + w):
            top_n, top_w = max(map(abs, n)), max(map(abs, w))
            if top_n and 99 <= top_w / top_n <= 101:
                return [round(v * 100, 2) for v in n], [round(v, 2) for v in w]
            if top_w and 99 <= top_n / top_w <= 101:
                return [round(v, 2) for v in n], [round(v * 100, 2) for v in w]
        return n, w

    columns_n, columns_w = list(zip(*narrow)), list(zip(*wide))
    for m in permutations(range(len(columns_w)), len(columns_n)):
        both = [forms(c, columns_w[i]) for c, i in zip(columns_n, m)]
        if set(zip(*[b[0] for b in both])) == set(zip(*[b[1] for b in both])):
            return True
    return False


def test_extra_columns_beside_percents(spark):
    rng = random.Random(12)
    pairs = {"percent": ([["a", "25%"], ["b", "7%"]], [["a", "x", 0.25], ["b", "y", 0.07]]), "other rows": ([["a", "25%"], ["b", "7%"]], [["a", "x", 0.07], ["b", "y", 0.25]])}
    for n in range(30):
        shares = [rng.randint(1, 99) / 100 for _ in range(rng.randint(2, 6))]
        wide = [[rng.choice("abc"), v, rng.randint(1, 3), rng.choice("xy")] for v in shares]
        narrow = [[f"{round(r[1] * 100)}%" if n % 2 else round(r[1] * 100), r[0]] for r in wide]
        if n % 3 == 0:
            narrow[0][0] = f"{round(shares[0] * 100) + 1}%" if n % 2 else round(shares[0] * 100) + 1
        pairs[str(n)] = (narrow, wide) if n % 4 else (wide, narrow)
    got = judge(spark, pairs, "lenient")
    assert {k: r.res for k, r in got.items()} == {k: int(brute_scaled(*v)) for k, v in pairs.items()}
    assert got["percent"].level == "scaled" and got["other rows"].res == 0 and 10 < sum(r.res for r in got.values()) < 30


def test_dense_money_columns(spark):
    """Every value within one cent, values close together, nothing else to tell rows by."""
    rng = random.Random(8)
    base = [[rng.randrange(2000, 2100) / 100 + 0.001, rng.randrange(500, 540) / 100 + 0.001] for _ in range(300)]
    noisy = [[round(x + rng.choice((-1, 0, 1)) / 100, 3) for x in r] for r in base]
    planted = noisy[:-1] + [[99.99, 5.1]]
    got = {k: (r.res, r.level) for k, r in judge(spark, {"noisy": (base, noisy), "planted": (base, planted)}, "lenient").items()}
    assert got == {"noisy": (1, "scaled"), "planted": (0, "none")}


def test_lenient_verdicts_weigh_rows_once(spark, monkeypatch):
    calls, weigh = [], parity.weigh
    monkeypatch.setattr(parity, "weigh", lambda coded: calls.append(1) or weigh(coded))
    e = spark.createDataFrame([("c", i, i * 3) for i in range(20)], "k string, a int, b int")
    rows = results.rows_from_frame(e, "k", "expected", ["a", "b"], "lenient").union(results.rows_from_frame(e, "k", "actual", ["b", "a"], "lenient"))
    got = parity.verdicts(rows, results.sides_of(rows), "lenient").collect()
    assert [(r.case_id, r.res, r.level) for r in got] == [("c", 1, "projection")] and len(calls) == 1


def test_groups_held_alike_are_not_sorted(spark, monkeypatch):
    seen, within = [], parity.within_tolerance
    monkeypatch.setattr(parity, "within_tolerance", lambda values, tol=1: seen.append(values.count()) or within(values, tol))
    side = lambda off: spark.createDataFrame([("c", f"g{i}", i + 0.5 + (off if i == 7 else 0)) for i in range(50)], "k string, g string, x double")
    rows = results.rows_from_frame(side(0), "k", "expected", ["g", "x"]).union(results.rows_from_frame(side(0.01), "k", "actual", ["g", "x"]))
    assert [(r.case_id, r.diff_rows) for r in parity.diff_scaled(rows).collect()] == [("c", 0)] and seen == [2]


def test_rows_without_a_choice_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(matching, "_round", None)  # would be called for shifts that differ from row to row
    rows = [("c", ["n"], [100 * i, 50 * i], 3, 0) for i in range(9)]
    rows += [("c", ["n"], [100 * i + d, 50 * i - d], 0, 1) for i in range(9) for d in (-1, 0, 1)]
    rows += [("short", ["n"], [0, 0], 1, 0), ("short", ["n"], [10, 0], 2, 0), ("short", ["n"], [1, 0], 0, 2), ("short", ["n"], [10, 1], 0, 1)]
    df = spark.createDataFrame(rows, "case_id string, grp array<string>, xs array<bigint>, n_e bigint, n_a bigint")
    assert {r.case_id for r in paired_cases(df).collect()} == {"c"}


def test_pairing_leaves_nothing_on_disk(spark, tmp_path, monkeypatch):
    """Two noisy columns: no scratch table of rows, neighbours or paths outlives the comparison, and no shuffle file a stored table."""
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    rng = random.Random(3)
    base = [("c", rng.randrange(900, 1000) / 100 + 0.001, rng.randrange(300, 340) / 100 + 0.001) for _ in range(40)]
    noisy = [(k, *[round(x + rng.choice((-1, 0, 1)) / 100, 3) for x in r]) for k, *r in base]
    side = lambda t, name: results.rows_from_frame(spark.createDataFrame(t, "k string, x double, y double"), "k", name)
    got = parity.diff_scaled(side(base, "expected").union(side(noisy, "actual"))).collect()
    assert [(r.case_id, r.diff_rows) for r in got] == [("c", 0)]
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "concord").iterdir()}
    large = {"scaled-rows", "several-noisy", "differing-groups", "near-rows", "near-nodes", "near-edges", "near-flow", "flow-change", "reached", "front", "paths",
             "found-paths", "forced", "senders", "takers", "open-rows"}
    assert "scaled-diffs" in left and not left & large
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    had = set(files())
    materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    new = lambda: [f for f in files() if "shuffle_" in f and f not in had]
    deadline = time.time() + 20
    while new() and time.time() < deadline:
        time.sleep(0.2)
    assert not new()


def test_rows_meet_once_for_all_columns(spark):
    """Neighbours by one shuffle of either side, and some more copies of rows than there are rows, not one for each shift."""
    rng = random.Random(4)
    at = lambda: [rng.randrange(-9000, 9000) for _ in range(3)]
    near = lambda x: [v + rng.choice((-1, 0, 1)) for v in x]
    e = [at() for _ in range(500)]
    a = [near(x) for x in e for _ in range(3)] + [[x[0] + 2, *x[1:]] for x in e[:200]]
    rows = [(i, "c", ["n"], x, 1, 0) for i, x in enumerate(e)] + [(500 + i, "c", ["n"], x, 0, 1) for i, x in enumerate(a)]
    rows += [(5000, "d", ["n"], [-1, 15], 1, 0), (5001, "d", ["n"], [0, 16], 0, 1), (5002, "d", ["m"], [0, 16], 0, 1)]
    df = spark.createDataFrame(rows, "id bigint, case_id string, grp array<string>, xs array<bigint>, n_e bigint, n_a bigint")
    edges = matching._neighbours(df, 1)
    got = sorted((r.u, r.v) for r in edges.collect())
    want = [(i, 500 + j) for i, x in enumerate(e) for j, y in enumerate(a) if all(abs(p - q) <= 1 for p, q in zip(x, y))]
    assert got == sorted([*want, (5000, 5001)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching._neighbours(df, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_groups_are_paired_in_batches(spark, monkeypatch):
    monkeypatch.setattr(matching, "_BATCH", 40)
    rows, sizes, unsettled = [], [], matching._unsettled
    monkeypatch.setattr(matching, "_unsettled", lambda rows, *rest: (rest[-1] == 0 and sizes.append(rows.count())) or unsettled(rows, *rest))
    for case, groups, far in (("one group", 1, 0), ("far", 1, 2), ("groups", 12, 0), ("far group", 12, 2), ("small", 1, 0), ("small, far", 1, 2)):
        n = 4 if groups == 12 else 3 if "small" in case else 60
        for g in range(groups):
            rows += [(case, [f"g{g}"], [7 * i, 5 * i], 1, 0) for i in range(n)]
            rows += [(case, [f"g{g}"], [7 * i + (i % 3 - 1 if i or g else far), 5 * i], 0, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, grp array<string>, xs array<bigint>, n_e bigint, n_a bigint")
    assert {r.case_id for r in paired_cases(df).collect()} == {"one group", "groups", "small"}
    assert len(sizes) >= 6 and sum(sizes) == df.groupBy("case_id", "grp", "xs").count().count() and max(sizes) <= 120


def test_runs_that_reach_nothing_else_are_settled_alone(spark, monkeypatch):
    """Dense noise on lines: few rows are left for the search; an uneven run decides its case; runs at borders are kept."""
    rng = random.Random(11)
    e = [(p, p // 40) for p in (rng.randrange(-5000, 5000) for _ in range(4000))]
    a = [tuple(v + rng.choice((-1, 0, 1)) for v in x) for x in e]
    rows = [(c, ["n"], list(x), n, 1 - n) for c, far in (("even", 0), ("uneven", 2)) for n, t in ((1, e), (0, [(max(e)[0] + far, max(e)[1]), *a[1:]] if far else a)) for x in t]
    df = spark.createDataFrame(rows, "case_id string, grp array<string>, xs array<bigint>, n_e bigint, n_a bigint")
    df = df.groupBy("case_id", "grp", "xs").agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))
    # against all rows: what a run that was left out could reach is in it
    all_rows = {(r.case_id, *r.xs): (r.n_e, r.n_a) for r in df.collect()}
    for shift in (0, 1):
        runs = matching._unsettled(df, 2, 1, shift).collect()
        kept = {(r.case_id, *x.xs) for r in runs if not r.uneven for x in r.rows}
        gone = all_rows.keys() - kept
        if shift == 0:
            assert len(gone) > len(all_rows) / 2
        uneven = {r.case_id for r in runs if r.uneven}
        for c, x, y in gone:
            if c not in uneven:
                reached = [(c, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                mixed = [k for k in reached if k in kept and ((all_rows[c, x, y][0] and all_rows[k][1]) or (all_rows[c, x, y][1] and all_rows[k][0]))]
                assert not mixed
    sizes, unpaired = [], matching._unpaired
    monkeypatch.setattr(matching, "_unpaired", lambda nodes, tol: sizes.append(nodes.count()) or unpaired(nodes, tol))
    even = df.filter("case_id = 'even'")
    assert [r.case_id for r in paired_cases(even, weighed=True).collect()] == ["even"] and sizes[0] < even.count() / 4
    uneven_rows = [("far", ["n"], [0, 0], 1, 0), ("far", ["n"], [2, 0], 0, 1), ("border", ["n"], [4095, 8], 1, 0), ("border", ["n"], [4096, 8], 0, 1)]
    small = spark.createDataFrame(uneven_rows, df.schema)
    assert {r.case_id for r in paired_cases(small).collect()} == {"border"}
