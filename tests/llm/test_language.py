import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import language, numtext
from tests.llm import helpers as H


def symbols(text):
    out = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    if not any(c.isalpha() for c in text or ""):
        return []
    kept = [c for c, before in zip(out, " " + out) if c != " " or before != " "]
    return ["   "[len(kept[max(0, i - 3) : i]) :] + "".join(kept[max(0, i - 3) : i + 1]) for i in range(len(kept))]


def kneser_ney(texts):
    """Probability of the last of four symbols, by the textbook recursion."""
    levels = {4: Counter(g for t in texts for g in symbols(t))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off, total, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for k, grams in levels.items():
        one, two = (sum(n == m for n in grams.values()) for m in (1, 2))
        off[k] = one / (one + 2 * two) if one and two else 0.75
        for g, n in grams.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += min(n, off[k])

    def p(g, k=4):
        if k == 0:
            return 2.0**-16
        g, head = g[-k:], g[-k:-1]
        if not total[k][head]:
            return p(g, k - 1)
        return max(levels[k][g] - off[k], 0) / total[k][head] + kinds[k][head] / total[k][head] * p(g, k - 1)

    return p


def sample(rng, lang, n):
    parts = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ße", "ter"], "cc": ["eau", "é", "tion", "qu"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def test_entropies_are_those_of_the_textbook():
    rng = random.Random(1)
    texts = {x: [sample(rng, x, 40) for _ in range(8)] + ["Zz 12  y"] for x in ("aa", "bb", "cc")}
    counts = {}
    for lang, own in texts.items():
        codes = np.concatenate([language.grams(d, o)[0] for _, _, d, o in numtext.slices(pa.array(own))])
        counts[lang] = np.unique(codes, return_counts=True)
    models = language.build(counts)
    asked = [sample(rng, x, 12) for x in texts] + ["漢字 kato", "", "12 ..", "a", "\U00010400x"]
    data, offsets = numtext.column(pa.array(asked))
    n, xent = models.entropies(data, offsets)
    for i, text in enumerate(asked[:-1]):
        own = symbols(text)
        assert n[i] == len(own)
        for j, lang in enumerate(sorted(texts)):
            if own:
                assert xent[i, j] == pytest.approx(-sum(map(math.log, map(kneser_ney(texts[lang]), own))) / len(own), rel=1e-4)


def test_held_out_languages(spark):
    rng = random.Random(2)
    rows = [(i, sample(rng, x, rng.randrange(3, 30)), x if i % 9 else None, "s") for i in range(240) for x in [rng.choice(["aa", "bb", "cc"])]]
    true = dict((i, t) for i, t, *_ in rows)
    got = language.identified(H.documents(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and true[r.doc_id]
        assert lang[r.doc_id] in (None, r.lang_pred)


def test_odd_rows(spark):
    rows = H.odd_documents(random.Random(3))
    df = H.documents(spark, rows, clashing=True)
    got = language.identified(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (2, 3, 4, 12):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and not by_id[i].accepted
    assert all(r.lang_pred in ("en", "de", "fr") for r in got if r.doc_id in (0, 5, 6, 8, 9, 10))
    unknown = language.identified(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert language.identified(df.limit(0)).count() == 0


def test_hash_arrays():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**62, 3000, dtype=np.uint64))
    held = language.HashArray(keys)
    at = held.find(keys)
    assert (held.order[at] == np.arange(len(keys))).all()
    assert (held.find(keys + np.uint64(1)) == -1).mean() > 0.99 and (language.HashArray(keys[:0]).find(keys) == -1).all()


def test_every_gram_of_a_large_corpus_counts(spark):
    """Models from Spark are those of the textbook on all grams, also of those that are rare among many symbols."""
    rng = random.Random(5)
    rows = [(i, sample(rng, "aa", 300), "aa", "s") for i in range(400)] + [(1000 + i, sample(rng, "bb", 30), "bb", "s") for i in range(40)]
    rows += [(2000 + i, x, "aa", "s") for i, x in enumerate(["Xylofoon zwijgt", "jij hebt \U00010400 gezien"] * 2)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert sum(len(symbols(t)) for _, t, x, _ in train if x == "aa") > 1 << 18 and any(t.startswith("Xylo") for _, t, *_ in train)
    models = language.trained(H.documents(spark, rows))
    asked = ["Xylofoon zwijgt", "jij hebt", "kato schung", "漢字"]
    n, xent = models.entropies(*numtext.column(pa.array(asked)))
    for j, lang in enumerate(["aa", "bb"]):
        p = kneser_ney([t for _, t, x, _ in train if x == lang])
        for i, text in enumerate(asked):
            assert n[i] == len(symbols(text))
            assert xent[i, j] == pytest.approx(-sum(map(math.log, map(p, symbols(text)))) / n[i], rel=1e-4)
    assert sum(len(symbols(t)) for t in asked) == n.sum() and models.grams[4].base[-1] == len({g for t in train for g in symbols(t[1])})
