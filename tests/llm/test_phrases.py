import collections
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from concord.llm import phrases
from tests.llm import helpers as H


def expected(rows, least, longest, top):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(H.LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    often = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        inside = any(
            l2 == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) and 100 * b >= 100 * a
            for (l2, h), b in often.items()
        )
        if not inside:
            score, k = min((1000 * a * total[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((" ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], total[lang], score))
    return sorted((lang, n + 1, *p) for lang, own in out.items() for n, p in enumerate(sorted(own, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top]))


def corpus(rng, n):
    common = ["new york city hall", "of the", "a a a a", "x\x01 y", "x y z", "x", "in the end", "\x00 q", "É é", "naïve 漢字"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.5 else H.prose(rng, rng.randrange(1, 6), 12) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "  ", "\t", ". ", "\n", ","]).join(parts).replace("new", rng.choice(["new", "New", "NEW"])), rng.choice(["en", "de", None, "und", ""]), "s"))
    return rows + [(n, "hot passage of words here. " * 400, "en", "s"), *H.odd_documents(rng)[:-6]]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, longest, top", [(10, 5, 2000), (3, 4, 25), (40, 2, 3)])
def test_against_counting_everything(spark, least, longest, top):
    rng = random.Random(1)
    rows = [r for r in corpus(rng, 120) if r[1] is None or len(r[1]) < 50_000]
    assert got(phrases.collocations(H.documents(spark, rows, clashing=True), least, longest, top)) == expected(rows, least, longest, top)


def test_phrases_of_a_word_in_many_tasks(spark, monkeypatch):
    """The hot first and last word lie over many ranges, and all bitmaps let nearly everything through."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the"] * 6 + list("abcdef")) for _ in range(60)), "en", "s") for i in range(60)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert got(phrases.collocations(H.documents(spark, rows), 3, 5)) == expected(rows, 3, 5, 2000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_buffers(spark, monkeypatch):
    rng = random.Random(3)
    rows = corpus(rng, 40)[:41]
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "PHRASES", 50)
    monkeypatch.setattr(phrases, "FILTER_BITS", 12)
    assert got(phrases.collocations(H.documents(spark, rows), 4)) == expected(rows, 4, 5, 2000)


def test_scores_are_exact(spark):
    a, n, left, right = 10**12 + 7, 9 * 10**15 + 1, 3 * 10**12 + 11, 2 * 10**12 + 13
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(phrases._score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first().s == 1000 * a * n // (left * right)


def test_nothing(spark):
    assert got(phrases.collocations(H.documents(spark, []))) == []
    assert got(phrases.collocations(H.documents(spark, [(1, None, None, None), (2, " . ", "en", "s")]))) == []


def test_a_phrase_is_spelled_once(spark, monkeypatch, tmp_path):
    """Neither tasks nor copies of a text make more rows of a phrase; an empty phrase a language tells its words."""
    rng = random.Random(4)
    prose = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(60)]
    rows = [(i, text, "en", "s") for i, text in enumerate(prose + ["copied text of some words"] * 300 + ["a b c d"] * 100)] + [(9, "a b", "de", "s")] * 20
    trimmed, folder = phrases.trimmed, str(tmp_path)

    def watched(task):
        def run(batches):
            for batch in task(batches):
                if batch.schema.names == ["lang", "words", "a"]:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(batch.num_rows))
                yield batch

        return trimmed(run)

    monkeypatch.setattr(phrases, "trimmed", watched)
    found = phrases.collocations(H.documents(spark, rows).repartition(16), 10)
    assert got(found) == expected(rows, 10, 5, 2000)
    f = collections.Counter((lang, w[i : i + k]) for _, t, lang, _ in rows for w in [tuple(t.split())] for k in range(6) for i in range(max(len(w) - k + 1, 0)))
    assert sum(int(x.read_text()) for x in tmp_path.iterdir()) == sum(n >= 10 for n in f.values())
