import random

import numpy as np
import pyarrow as pa

from concord.llm import numtext
from tests.llm import helpers as H


def test_words_and_hashes_over_slices(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "a", "  a\x0bB ", "é x", "x" * 5000, *(H.prose(rng, rng.randrange(60)) for _ in range(200)), "", " "]
    monkeypatch.setattr(numtext, "_SEGMENT", 64)
    by_hash, seen = {}, 0
    for size in (1, 100, 1 << 20):
        for a, b, data, offsets in numtext.slices(pa.array(texts)[:], size):
            starts, ends, row = numtext.words(data, offsets)
            assert [[data[s:e].tobytes().decode() for s, e, r in zip(starts, ends, row) if r == i] for i in range(b - a)] == [
                H.WORD.findall(t or "") for t in texts[a:b]
            ]
            for h, s, e in zip(numtext.hashes(data, starts, ends, lower=True).tolist(), starts, ends):
                word = data[s:e].tobytes().decode().translate(H.LOWER)
                assert by_hash.setdefault(h, word) == word
                seen += 1
    assert len(by_hash) == len({w for t in texts for w in H.words(t)}) and seen


def test_windows_stay_in_rows():
    values, rows = np.arange(10, dtype=np.uint64), np.array([0, 0, 0, 0, 1, 1, 2, 2, 2, 2])
    _, at = numtext.windows(values, rows, 3)
    assert at.tolist() == [0, 1, 6, 7]
    assert len(numtext.windows(values[:2], rows[:2], 3)[0]) == 0


def test_sliced_and_null_columns():
    data, offsets = numtext.column(pa.array(["zz", "ab", None, "c"])[1:])
    assert data.tobytes() == b"abc" and offsets.tolist() == [0, 2, 2, 3]
    data, offsets = numtext.column(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]
