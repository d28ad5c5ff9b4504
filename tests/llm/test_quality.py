import random
import zlib

import numpy as np
import pyarrow as pa

from concord.llm import numtext, quality
from tests.llm import helpers as H

LABELS = "doc_id long, quality int, toxic int"


def marked(rng, n=400):
    """Clean prose is 1, prose with marks on its words is 0."""
    rows, labels = [], []
    for i in range(n):
        text, good = H.prose(rng, rng.randrange(5, 120)), rng.random() < 0.7
        rows.append((i, text if good else " ".join(w + rng.choice(["###", "$$$"]) for w in text.split()), "en", "s"))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rng = random.Random(1)
    rows, labels = marked(rng)
    docs, marks = H.documents(spark, rows, clashing=True), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality.predictions(docs, marks).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    bad = {i for i, t, *_ in rows if "#" in t or "$" in t}
    held = [r for i, r in got.items() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id not in bad) for r in held]) > 0.97
    # labels of the held-out fold do not matter, nor do repeats and nulls
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels] + labels[:0] + [(None, 1, 1), (0, None, None)]
    again = {r.doc_id: r.score for r in quality.predictions(docs, spark.createDataFrame(turned + [x for x in turned if x[0] is not None][:20], LABELS)).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = quality.accepted(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_sample_is_a_bound(spark):
    """One row an id counts, the same however rows are dealt."""
    rng = random.Random(5)
    rows = [(7, H.prose(rng, 20), "en", "s") for _ in range(300)] + [(7, "copy of it", "en", "s")] * 100 + [(i, H.prose(rng, 30), "en", "s") for i in range(20, 60)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 1, 0)], LABELS)
    x, y = quality.labelled_statistics(H.documents(spark, rows), marks, sample=5)
    assert len(x) == len(y) <= 5
    whole = [quality.labelled_statistics(H.documents(spark, rows).repartition(n), marks)[0] for n in (1, 5)]
    assert np.array_equal(*whole) and len(whole[0]) <= 41


def test_odd_rows(spark):
    rows = H.odd_documents(random.Random(2))
    docs = H.documents(spark, rows, clashing=True)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (None, None, None)], LABELS)
    for marks in (labels, labels.limit(0)):
        got = quality.predictions(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out for r in got if r.doc_id is None)
    assert quality.predictions(docs.limit(0), labels).count() == 0


def test_flat_trees_score_as_node_by_node():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=30)

    def walk(row, at):
        while model.child[at][0] != at:
            j = model.feature[at]
            at = model.child[at][int(np.searchsorted(model.edges[j], row[j], "left") > model.bin[at])]
        return model.value[at]

    got = model.score(x[:60])
    want = [1 / (1 + np.exp(-(model.base + sum(walk(r, t) for t in model.roots)))) for r in x[:60]]
    assert np.allclose(got, want) and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97


def test_constant_labels_and_slices():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.fit(np.ones((9, 3)), np.ones(9)).score(np.ones((1, 3))) > 0.9).all()
    texts = pa.array(["A b.\nA b.", None, "", "###", "x " * 3000] * 20)
    whole = np.concatenate([quality.statistics(d, o) for _, _, d, o in numtext.slices(texts)])
    parts = np.concatenate([quality.statistics(d, o) for _, _, d, o in numtext.slices(texts, 10)])
    assert whole.shape == (100, quality._width()) and np.allclose(whole, parts)
