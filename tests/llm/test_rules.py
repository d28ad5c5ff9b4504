import random

import numpy as np

from concord.llm import rules
from tests.llm import helpers as H


def test_counts_and_verdicts(spark):
    rng = random.Random(1)
    rows = H.odd_documents(rng) + [(100 + i, "\n".join(H.prose(rng, rng.randrange(12), 9) for _ in range(rng.randrange(9))), "en", "s") for i in range(150)]
    rows += [(400 + i, " ".join(w + "$$$" for w in H.prose(rng, 90).split()), "en", "s") for i in range(60)]
    rows += [(600 + i, ". ".join(H.prose(rng, 12) + " to of a in it" for _ in range(9)), "en", "s") for i in range(300)]
    got = rules.judged(H.documents(spark, rows, clashing=True)).collect()
    counts = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert H.plain(counts) == H.plain((i, *H.base_measures(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5) and 0 <= r.posterior <= 1
    assert not any(r.kept for r in got if r.doc_id and 400 <= r.doc_id < 600)
    assert all(r.kept for r in got if r.doc_id and r.doc_id >= 600)
    assert rules.judged(H.documents(spark, [])).count() == 0


def test_accuracies_are_found_again():
    rng = np.random.default_rng(2)
    n, good, bad = 40_000, np.array([0.97, 0.9, 0.95, 0.99, 0.9]), np.array([0.7, 0.8, 0.4, 0.6, 0.75])
    truth = rng.random(n) < 0.8
    right = rng.random((n, 5)) < np.where(truth[:, None], good, bad)
    v = np.where(right == truth[:, None], rules.GOOD, rules.BAD)
    v[rng.random((n, 5)) < 0.2] = rules.ABSTAIN
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = rules.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02 and np.abs(model.good - good).max() < 0.02 and np.abs(model.bad - bad).max() < 0.06
    assert ((model.posterior(v) >= 0.5) == truth).mean() > 0.94
    assert rules.estimate(np.zeros((0, 5), int), np.zeros(0)).prior == 0.9


def test_patterns_are_votes():
    codes = np.arange(3**rules.RULES)
    assert ((rules.patterns(codes) * rules._PLACES).sum(1) == codes).all()
