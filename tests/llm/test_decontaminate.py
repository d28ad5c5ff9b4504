import collections
import random

import regex

from concord.llm import decontaminate as D
from tests.llm import helpers as H

ITEMS = "item_id long, text string"


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def bag(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def best_matches(rows, items):
    """All windows of every item's length in every document."""
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for item_id, passage in items:
            own = words(passage)
            if not own or not w:
                continue
            for i in range(max(1, len(w) - len(own) + 1)):
                x, y = bag(w[i : i + len(own)]), bag(own)
                shared, total = sum((x & y).values()), sum((x | y).values())
                if 100 * shared >= 75 * total:
                    key = (doc_id, item_id)
                    out[key] = max(out.get(key, 0), shared / total)
    return out


def leaky(rng):
    items = [(i, H.prose(rng, rng.choice([1, 3, 6, 12, 40, 70]), 3000).capitalize() + ".") for i in range(24)]
    items += [(50, None), (51, ""), (52, "!!!"), (None, H.prose(rng, 20, 3000)), (53, items[5][1]), (54, "again " * 12)]
    rows = []
    for i in range(160):
        passage = rng.choice(items)[1] or ""
        for _ in range(rng.randrange(3)):
            w = passage.split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            passage = " ".join(w)
        passage = rng.choice([passage, passage.upper(), passage.replace(" ", "## ")])
        rows.append((i, f"{H.prose(rng, rng.randrange(50), 3000)} {passage} {H.prose(rng, rng.randrange(50), 3000)}", "en", "s"))
    return rows + [(900 + i, x, "en", "s") for i, x in enumerate(["again " * 14, "", None, "w1"])], items


def test_against_all_windows(spark):
    rows, items = leaky(random.Random(10))
    got = {(r.doc_id, r.item_id): r.shared / r.total for r in D.matches(H.documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    want = best_matches(rows, items)
    sure = {k for k, v in want.items() if v >= 0.85}
    assert sure and sure <= set(got) and set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.05 * len(want)  # fingerprints beyond the radius, near the limit
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items() if k in sure)


def test_odd_rows_and_filter(spark):
    rows = H.odd_documents(random.Random(11))
    items = spark.createDataFrame([(1, "ONE"), (2, rows[4][1]), (3, None), (4, rows[6][1])], ITEMS).selectExpr("*", "'x' AS words", "1 AS n_words")
    df = H.documents(spark, rows, clashing=True)
    got = D.decontaminated(df, items)
    assert got.columns == df.columns
    # item 4 is the text of the first row without an id; the other row without one stays
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 1, 2, 3, 4, 8, 9, 10, 11, 12] and ids.count(None) == 1
    leak = H.prose(random.Random(12), 30)
    own = H.documents(spark, [(1, "before " + leak, "en", "a"), (1, "clean text", "en", "a"), (None, leak, None, None), (None, "clean too", None, None)])
    assert sorted(r.text for r in D.decontaminated(own, spark.createDataFrame([(7, leak)], ITEMS)).collect()) == ["clean text", "clean too"]
    none = spark.createDataFrame([], ITEMS)
    assert D.matches(df, none).count() == 0 and D.matches(df.limit(0), items).count() == 0
    assert D.decontaminated(df, none).count() == len(rows)


def test_blocks_meet_within_the_radius():
    """Pigeonhole: any flips up to RADIUS leave a block with at most FLIPS of them."""
    rng = random.Random(12)
    for _ in range(500):
        bits = rng.sample(range(D.BLOCKS * D.BLOCK_BITS), D.RADIUS)
        assert min(collections.Counter({b: 0 for b in range(D.BLOCKS)} | collections.Counter(b // D.BLOCK_BITS for b in bits)).values()) <= D.FLIPS


def moved(rng):
    """Passages with halves swapped, a part moved, words put in or left out, inside longer documents."""
    items = [(i, H.prose(rng, rng.choice([24, 60, 90, 120]), 3000)) for i in range(16)]
    rows = []
    for i in range(120):
        w = rng.choice(items)[1].split()
        at = rng.randrange(len(w) // 3, 2 * len(w) // 3)
        w = rng.choice([
            lambda: w[len(w) // 2 :] + w[: len(w) // 2], lambda: w[at:] + w[:at], lambda: w[:at] + ["put", "in"] + w[at:],
            lambda: w[:at] + w[at + 2 :], lambda: w[: at - 5] + w[at:] + w[at - 5 : at], lambda: w[at:] + ["between"] + w[:at],
        ])()
        rows.append((i, f"{H.prose(rng, rng.randrange(120), 3000)} {' '.join(w)} {H.prose(rng, rng.randrange(120), 3000)}", "en", "s"))
    return rows, items


def test_moved_parts_against_all_windows(spark):
    rows, items = moved(random.Random(13))
    got = {(r.doc_id, r.item_id): r.shared / r.total for r in D.matches(H.documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    want = best_matches(rows, items)
    sure = {k for k, v in want.items() if v >= 0.85}
    assert len(sure) > 20 and sure <= set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.05 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in sure)


def test_every_window_that_can_reach_the_limit(spark):
    """Windows are those whose shingles lie in items of their length often enough, and no others."""
    rows, items = moved(random.Random(14))
    rows += leaky(random.Random(15))[0][:40]
    held = D.passages(spark.createDataFrame(items, ITEMS))
    own, sizes = {}, collections.Counter(len(words(x)) for _, x in items)
    for _, x in items:
        own.setdefault(len(words(x)), set()).update(bag(words(x)))
    want = 0
    for w in {tuple(words(t)) for _, t, *_ in rows if t}:
        for n in sizes:
            long = min(n, len(w))
            for s in range(len(w) - long + 1) if long >= 5 else []:
                hits = sum(tuple(w[i : i + 5]) in own[n] for i in range(s, s + long - 4))
                want += hits > 0 and hits * 175 >= 75 * (long + n - 8)
    distinct = {tuple(words(t)): (i, t, *more) for i, t, *more in rows if t}
    assert D.item_sized_windows(H.documents(spark, list(distinct.values())), held).count() == want > 0
