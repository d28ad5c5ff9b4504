import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from concord.llm import numtext, pieces
from tests.llm import helpers as H

FILE = pieces.default_model()


@pytest.fixture(scope="module")
def data():
    with open(FILE, "rb") as f:
        return f.read()


def encode(model, texts):
    out = []
    for _, _, data, offsets in numtext.slices(pa.array(texts, pa.string())):
        ids, rows = pieces.encode_slice(model, data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    return out


def texts(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz   .,éß漢🙂01\n▁\t-="
    parts = ["th", "e", "in", "er", "an", "re", "on", " t", "▁", "he", "-", "__", "  ", "ing", "1", "é"]
    return [
        "", " ", "   ", "▁", "▁x ▁ ", "\x00a", "a" * 333, "ab" * 200, "<s></s><unk><0x0A>", "漢字🙂é", "\n\t\r ", "." * 50, "12345678901234567890", None, "x" * 5000,
        *("".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(n)),
        *("".join(rng.choice(parts) for _ in range(rng.randrange(300))) for _ in range(n)),
        *("".join(rng.choice("aeinrst") for _ in range(rng.randrange(200))) for _ in range(n)),
        *("".join(rng.choice(" -=_*#/") for _ in range(rng.randrange(200))) for _ in range(n)),
        *(H.prose(rng, rng.randrange(300)) for _ in range(n)),
    ]


def test_as_the_library(data):
    own, library = texts(random.Random(1), 200), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert encode(pieces.Model(data), own) == library.encode([t or "" for t in own])


def test_long_text_in_parts(data, monkeypatch):
    rng, library = random.Random(2), sentencepiece.SentencePieceProcessor(model_proto=data)
    own = [H.prose(rng, 4000) + " " + "é漢🙂 z" * 300, "x" * 9000, "ab" * 7000 + " c", "🙂" * 3000, "the " * 3000]
    monkeypatch.setattr(pieces, "LONG", 1000)
    for t in own:
        assert encode(pieces.Model(data), [t]) == library.encode([t])


def field(n, value):
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return number(n << 3 | 5) + struct.pack("<f", value)
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def handmade(words):
    """A model file with the given pieces and scores; scores need not follow any training."""
    piece = lambda p, score, kind: field(1, field(1, p.encode()) + field(2, float(score)) + field(3, kind))
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    out += b"".join(piece(p, s, 1) for p, s in words)
    return out + field(2, field(3, 2) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("seed", range(12))
def test_any_vocabulary(seed):
    """Scores in any order, also equal ones, so that a merge can make a better pair than those of its round."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([10, 40, 120]))}
    data = handmade([(w, -rng.randrange(1, rng.choice([8, 300]))) for w in sorted(words)])
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = ["".join(rng.choice("abc d") for _ in range(rng.randrange(60))) for _ in range(800)] + ["ab" * 30, "abc" * 20, "a" * 41, "aab" * 15]
    assert encode(pieces.Model(data), own) == library.encode(own)


def test_other_models_are_refused(data):
    with pytest.raises(ValueError):
        pieces.Model(handmade([("a", -1)]).replace(field(2, field(3, 2) + field(35, 1)), field(2, field(3, 1) + field(35, 1))))
    assert pieces.Model(data).size == 32000


def test_rows(spark, data):
    rng, library = random.Random(3), sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = H.odd_documents(rng) + [(100 + i, t, "en", "s") for i, t in enumerate(texts(rng, 10))]
    docs = H.documents(spark, rows, clashing=True)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.digests(pieces.round_trip(docs))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    whole = pieces.encoded(docs, ids="pieces")
    assert whole.columns == [*docs.columns, "pieces"] and whole.count() == len(rows)
    assert pieces.digests(pieces.round_trip(H.documents(spark, []))).count() == 0


def test_merges_keep_word_order():
    m = pieces.Model(handmade([("a", -5), ("b", -5), ("ab", -1), ("abab", -2)]))
    ids, sizes = pieces.merged(m, m.char[np.array([97, 98, 97, 98, 97, 98, 98])], np.array([4, 1, 2]))
    assert sizes.tolist() == [1, 1, 2] and len(ids) == 4
