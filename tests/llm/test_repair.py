import hashlib
import random
import zlib

import numpy as np
import pytest

from concord.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def broken(rows):
    """Rows of (conv_id, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        hit, role, text = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20, some(role), some(text)
        own = out.setdefault(conv, [])
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        own += [(turn, role, text)] * (hit != 0) * (2 if hit == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def cheapest(rows):
    """Cost and least audit of (role, text, fault) rows by trying every edit at every place, and the rows left."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {s: min((2 * k, "I" * k, ("user:", "assistant:")[(s == "u") :][:0]) for k in ([0] if s in ("", "a") else [1] if s == "u" else [2])) for s in after}
    best = {s: (cost, audit, tuple({"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[s])) for s, (cost, audit, _) in best.items()}
    for role, text, fault in reversed(rows):
        own = {}
        for s in after:
            ways, late = [(best[s][0] + 3, "D" + best[s][1], best[s][2])], fault == "truncated"
            if fault not in ("blank", "duplicate"):
                if role[:1] in after[s]:
                    c, a, left = best[after[s][role[:1]]]
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *left)))
                c, a, left = best[nexts[s]]
                ways.append((c + 2 + late, "R" + a, (("assistant" if nexts[s] == "a" else "user") + ":" + text, *left)))
            own[s] = min(ways)
        for _ in range(4):  # inserts before the row
            for s in after:
                c, a, left = own[nexts[s]]
                own[s] = min(own[s], (c + 2, "I" + a, (("assistant:" if nexts[s] == "a" else "user:"), *left)))
        best = own
    return best[""]


def expected(rows):
    after, out = broken(rows), []
    for conv in {r[0] for r in rows}:
        own, seen, marked = after.get(conv, []), set(), []
        turns = [t for t, _, _ in own if t is not None]
        for _, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        count = lambda f: sum(x == f for _, _, x in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, left = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n, conv0=0):
    rows = []
    for conv in range(conv0, conv0 + n):
        for turn in range(rng.randrange(1, 12)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Sam", "udder"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "No", "What? ", " \t", "", "Fine!\n", f"Text {rng.randrange(5)}", "é。", "…", None])))
    return rows


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        for c in ("conv", "n", "part", "seg", "has", "copies", "audit", "first"):
            df = df.selectExpr("*", f"1 AS `{c}`")
    return sorted((tuple(r) for r in repair.repaired(df).collect()), key=repr)


def test_against_trying_every_edit(spark):
    rng = random.Random(1)
    rows = conversations(rng, 300)
    rows += rng.choices(rows, k=200)  # repeated rows
    rows += [(None, t, r, "Text.") for t, r in enumerate(["user", "assistant", "user", None])]
    rows += [(9000, 1, "user", "x" * 200_000), (9000, 2, "assistant", "y. " * 100_000), (9001, None, None, None), (9002, None, "user", "a."), (9002, None, "assistant", "b.")]
    assert got(spark, rows, extra=True) == expected(rows)


def test_long_conversations_in_segments(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(7, t, ["user", "assistant", "system"][t % 2 if rng.random() < 0.9 else rng.randrange(3)], rng.choice(["Yes.", f"Text {t}.", f"Cut {t}"])) for t in range(7000)]
    rows += [(8, 3, "user", "the same.")] * 5000 + [(8, t, "user", "the same.") for t in range(3000)] + conversations(rng, 40, 20)
    want = expected(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 5)
    assert got(spark, rows[:900]) == expected(rows[:900])


def test_nothing(spark):
    assert got(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(spark, [(gone, 1, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 12345])
def test_runs_pass_by_powers(n):
    for sym in range(9):
        slow = repair.row_matrix(sym)
        for _ in range(n - 1) if n < 100 else ():
            slow = repair.times(slow, repair.row_matrix(sym))
        if n < 100:
            assert np.array_equal(repair.run_matrix(sym, n), slow)
        assert np.array_equal(repair.run_matrix(sym, n), repair.times(repair.run_matrix(sym, n // 3), repair.run_matrix(sym, n - n // 3)) if n >= 3 else slow)
