import random

import pytest
from pyspark.sql import functions as F

from concord.llm import mixing
from tests.llm import helpers as H


def filled(sizes, cap=3):
    """Targets by sharing again and again, as the rule reads."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def corpus(rng, n=600):
    rows = [(i, H.prose(rng, rng.choice([0, 1, 5, 30, 200])), "en", rng.choice(["a", "b", "B", "é", "tiny", None])) for i in range(n)]
    return [r if r[3] != "tiny" or r[0] % 40 == 0 else (*r[:3], "a") for r in rows]


def test_targets_and_words_taken(spark):
    rng = random.Random(2)
    rows = corpus(rng)
    got = mixing.mix(H.documents(spark, rows, clashing=True)).collect()
    size = {i: len(H.WORD.findall(t)) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    target, taken = filled(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        copies = target[s] / sizes[s] if sizes[s] else 0
        assert r["size"] == 0 or r.taken // r["size"] in (int(copies), int(copies) + 1)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(5, 0.02 * target[s])


def test_odd_rows_reruns_and_copies(spark):
    rows = H.odd_documents(random.Random(3))
    df = H.documents(spark, rows, clashing=True)
    first, again = (H.plain(mixing.mix(x).collect()) for x in (df, df.repartition(3)))
    assert first == again and len(first) == len(rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = out.select(F.sum(mixing.n_words("text"))).first()[0]
    assert words == sum(r[4] for r in first)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_weights_are_inclusion_odds(spark):
    """Heavier documents are taken more often, and each source still comes near its target."""
    rows = [(i, H.prose(random.Random(i), 20), "en", "ab"[i % 2]) for i in range(1200)]
    df = H.documents(spark, rows).withColumn("w", F.expr("CASE WHEN doc_id % 4 < 2 THEN 3.0 ELSE 1.0 END"))
    got = mixing.mix(df, weight="w").collect()
    heavy = sum(r.taken for r in got if r.doc_id % 4 < 2)
    light = sum(r.taken for r in got if r.doc_id % 4 >= 2)
    assert 2.4 < heavy / light < 3.6 and max(r.taken for r in got) <= 60
    for s in (0, 1):
        own = [r for r in got if r.doc_id % 2 == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
