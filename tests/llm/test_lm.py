import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import lm, succinct
from tests.llm import helpers as H

END = ("end",)


def tokens(text):
    return [*H.words(text), END]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def model(rows, order=3, least=2, off=lm.DISCOUNT):
    """Counts and the probability of a token after those before it, by dictionaries."""
    train = [tokens(t) for i, t, *_ in rows if not held(i)]
    counts = {k: Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    for k in range(3, order + 1):
        counts[k] = Counter({g: n for g, n in counts[k].items() if counts[k - 1][g[:-1]] >= least})
    total, kept = Counter(), Counter()
    for k in range(2, order + 1):
        for g, n in counts[k].items():
            total[g[:-1]] += n
    for k in range(2, order + 1):
        for g, n in counts[k].items():
            if n >= least:
                kept[g[:-1]] += (n - off) / total[g[:-1]]
    size, kinds = sum(counts[1].values()), len(counts[1])

    def p(w):
        out = (counts[1][w[-1:]] + 1) / (size + kinds + 1)
        for k in range(2, min(order, len(w)) + 1):
            g = w[-k:]
            if total[g[:-1]]:
                n = counts[k][g]
                out = (max(n - off, 0) / total[g[:-1]] if n >= least else 0) + (1 - kept[g[:-1]]) * out
        return out

    return counts[1], size, kinds, p


@pytest.mark.parametrize("order, shard", [(3, 1 << 22), (4, 60), (1, 1 << 22)])
def test_scores(spark, monkeypatch, order, shard):
    monkeypatch.setattr(lm, "SHARD", shard)
    rng = random.Random(1)
    rows = [(i, H.prose(rng, rng.randrange(30), 30), "en", "s") for i in range(120)] + [(None, "w1 w2 w3 unseen", "en", "s"), (500, None, None, None), (501, "", "en", "s")]
    counts, size, kinds, p = model(rows, order)
    docs = H.documents(spark, rows, clashing=True)
    trie = lm.trained(docs, order=order)
    assert trie.total == size and trie.kinds == kinds and len(trie.files) == order and (shard > 100 or trie.shards > 1)
    texts = {(i, t): tokens(t) for i, t, *_ in rows}
    by_id = {i: w for (i, _), w in texts.items()}
    got = lm.scored(docs, trie).collect()
    assert len(got) == len(rows)
    for r in got:
        w = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(counts[(x,)] > 0 for x in w), size)
        assert r.base_score == pytest.approx(sum(math.log10((counts[(x,)] + 1) / (size + kinds + 1)) for x in w))
        want = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))
        assert r.score == pytest.approx(want, abs=3e-4 * order * len(w))


def test_odd_rows(spark):
    rows = H.odd_documents(random.Random(2))
    got = lm.scored(H.documents(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows) and all(r.n_tokens == len(tokens(t)) for r in got for i, t, *_ in rows if i == r.doc_id is not None)
    assert lm.scored(H.documents(spark, [])).count() == 0
    alone = lm.scored(H.documents(spark, [(None, "a b", None, None)])).collect()[0]
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.score) == (3, 0, 0, 0.0)


def test_packed_and_monotone_sequences(tmp_path):
    rng = np.random.default_rng(3)
    for bits in (1, 7, 23, 32, 40, 63):
        values = rng.integers(0, 1 << bits, 500, dtype=np.uint64)
        assert (succinct.unpack(succinct.pack(values, bits), bits, np.arange(500)) == values.astype(np.int64)).all()
    for n, universe in ((1, 1), (5, 3), (1000, 10), (1000, 100_000), (5000, 1 << 40)):
        values = np.sort(rng.integers(0, universe, n))
        held_ = succinct.elias_fano(values, universe)
        succinct.write_bundle(str(tmp_path / f"{n}-{universe}"), held_)
        held_ = succinct.read_bundle(str(tmp_path / f"{n}-{universe}"))
        at = rng.integers(0, n, 300)
        assert (succinct.elias_fano_at(held_, at) == values[at]).all()
    jump = np.array([0, 0, 0, 100_000, 100_000, 100_001])
    assert succinct.elias_fano_at(succinct.elias_fano(jump, 100_002), np.arange(6)).tolist() == jump.tolist()


def test_quantised_probabilities():
    p = np.array([1.0, 0.5, 1e-3, 1e-15, 0.0 + 1e-16])
    assert np.allclose(np.log10(lm.restored(lm.quantised(p))), np.log10(p), atol=1e-3)


def test_query_keeps_what_occurs_once(spark, tmp_path):
    """The registered query scores a sequence seen once in training above the same words in another order."""
    seen = "oak ash elm fir yew bay"
    own = next(i for i in range(2000, 2100) if not held(i))
    a, b = [i for i in range(1000, 1100) if held(i)][:2]
    rows = [(own, seen, "en", "s")] + [(i, H.prose(random.Random(i), 30), "en", "s") for i in range(60)]
    rows += [(a, seen, "en", "s"), (b, "yew oak fir bay ash elm", "en", "s")]
    H.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in lm.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[a] > got[b] + 0.5
