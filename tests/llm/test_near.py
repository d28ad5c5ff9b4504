import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from concord.llm import components, near, numtext
from tests.llm import helpers as H


def family(rng):
    """Copies, near copies on both sides of the limit, chains, and a passage that many texts share."""
    rows, passage = [], H.prose(rng, 30)
    for g in range(12):
        own = H.prose(rng, rng.choice([3, 5, 6, 20, 80, 200])).split()
        for _ in range(6):
            text = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text), "en", "s"))
        rows.append((len(rows), rows[-1][1].upper(), "en", "s"))
    for _ in range(40):
        rows.append((len(rows), H.prose(rng, rng.choice([5, 9, 40, 120])) + " " + passage, "en", "s"))
    return rows


def test_join_against_all_pairs(spark):
    rng = random.Random(4)
    rows = family(rng) + [(1000 + (i or 0), t, x, s) if i is not None else (i, t, x, s) for i, t, x, s in H.odd_documents(rng)]
    got = near.labelled(H.documents(spark, rows, clashing=True)).select("doc_id", "n_shingles", "component_id").collect()
    assert H.plain(got) == H.plain(H.near_components(rows))


def test_small_tiles_find_the_same(spark, monkeypatch):
    """Blocks of a band, and a link that no hub shows: all tiles must be met."""
    rng = random.Random(5)
    rows = family(rng)
    monkeypatch.setattr(near, "TILE", 4)
    held, links, _ = near.join(H.documents(spark, rows))
    classes = held.filter("n > 0").groupBy("cls").agg(*[F.min(c).alias(c) for c in ("n", "bits", "wide")])
    monkeypatch.setattr(near, "FEW", 2)
    shared = near.shared_tokens(H.documents(spark, rows), 10_000)
    entries = shared.filter("token is not null").withColumnRenamed("a", "cls")
    none = spark.createDataFrame([], "node long, root long")
    pairs = {(r.a, r.b) for r in near.tiles(entries, classes, none).collect()}
    sets = {}
    for _, t, *_ in rows:
        data, offsets = numtext.column(pa.array([t]))
        values = near.shingle_sets(data, offsets)[0]
        if len(values):
            sets[near.class_of(values)] = values
    names = sorted(sets)
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if linked(sets[a], sets[b])}
    pairs |= {(r.a, r.b) for r in shared.filter("token is null").collect()}
    assert want and want <= pairs
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} <= want


def test_sets_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """With six bits of the first hash nearly all sets share it; the second keeps them apart."""
    plain = near.class_of
    monkeypatch.setattr(near, "class_of", lambda values, seed=0: plain(values, seed) if seed or not len(values) else plain(values) & 63)
    rows = family(random.Random(8))[:60]
    data = [near.shingle_sets(*numtext.column(pa.array([t])))[0] for _, t, *_ in rows]
    hashes = frozenset(near.class_of(x) for x in data)
    names = {near.name_of(x, hashes): x.tobytes() for x in data}
    assert len(names) == len({x.tobytes() for x in data}) > len(hashes)


def test_tokens_dealt_out(spark, monkeypatch):
    """Frequent tokens whose sets lie in several parts still link all of their sets."""
    rng = random.Random(9)
    base = H.prose(rng, 60).split()
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s"))
    monkeypatch.setattr(near, "PART", 8)
    got = near.labelled(H.documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert H.plain(got) == H.plain(H.near_components(rows))
    hubs = near.shared_tokens(H.documents(spark, rows), 10_000).filter("hub").count()
    assert hubs > 0


def test_one_of_each_by_whole_rows(spark):
    """Rows equal in id and text but not in their source: the same one stays, however rows are dealt."""
    text = H.prose(random.Random(10), 50)
    rows = [(1, text, "en", s) for s in "dbca"] + [(None, text + " more", "en", s) for s in "yx"] + [(None, "  ", None, "s"), (None, "  ", None, "s"), (None, None, None, "t")]
    kept = [sorted(map(repr, near.one_of_each(H.documents(spark, rows).repartition(n)).collect())) for n in (1, 3, 4)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3


def test_one_of_each(spark):
    rng = random.Random(6)
    rows = H.odd_documents(rng)
    df = H.documents(spark, rows, clashing=True)
    got = near.one_of_each(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12] and ids.count(None) == 1


def test_empty_table(spark):
    none = H.documents(spark, [])
    assert near.labelled(none).count() == 0 and near.one_of_each(none).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300)]
    edges = [(a * 7919 % 10007, b * 7919 % 10007) for a, b in rng.sample(edges, len(edges))]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len(roots) == 61 + 40 and all(roots[a] == roots[b] for a, b in edges if a != b) and len(set(roots.values())) == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 400):
        least = -(-75 * n // 100)
        assert near.prefix_length(n) + least == n + 1
