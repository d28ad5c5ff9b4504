import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from concord.llm import numtext, token_ids
from concord.session import scratch_path
from tests.llm import helpers as H

PATH = token_ids.default_tokenizer()
AWKWARD = [
    "a  b\n\n c <|endoftext|> d", "  x  y é ü", " lead", "trail ", "x 's don't  we'll\t t", "", "  　 a  b", "1 2 33 4a", "a \x1c b", "é à ñ",
    "a.b,c (d) e! <|endoftext|>, x<|endoftext|>y", "é.ñ, ÷. ×, a×. d'accord. l'été, x's. a’b. ç», «a», 3.4a.", "word.\nNext$$$ a### b", "漢字 🙂 \U0001f600.",
]


def encoded(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice(" \n\t.,'aZé«×|<>1$ s漢") for _ in range(rng.randrange(60))) for _ in range(1500)]
    got = []
    for _, _, data, offsets in numtext.slices(pa.array(texts), 2000):
        ids, counts = token_ids.encode_slice(PATH, data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_lengths_are_huffman_where_they_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 700):
        counts = rng.integers(0, 1000, n) ** 2
        lengths = token_ids.code_lengths(counts, 40).astype(int)
        used = counts > 0
        heap = [(int(c), 0) for c in counts[used]]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            best += a + b
            heapq.heappush(heap, (a + b, 0))
        assert (lengths[~used] == 0).all() and (n < 3 or (lengths * counts).sum() == best)
    steep = token_ids.code_lengths(2 ** np.arange(40)).astype(int)
    assert steep.max() == token_ids.LONGEST and sum(2.0**-x for x in steep) <= 1


@pytest.mark.parametrize("n", [0, 1, 5, token_ids.BLOCK, token_ids.BLOCK + 1, 20_000])
def test_bits_round_trip(n, tmp_path):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
    lengths = token_ids.code_lengths(np.bincount(ids, minlength=50_257))
    codes = token_ids.canonical(lengths)
    sizes = np.array([n // 3, n - n // 3])
    path = str(tmp_path / "x.ids")
    (tmp_path / "x.ids").write_bytes(token_ids._file_bytes([7, None], sizes, ids, lengths, codes))
    held = token_ids.Ids(path)
    assert np.array_equal(held.ids(0, n), ids)
    assert [(d, len(x)) for d, _, x in held.documents(100)] == [(7, n // 3), (None, n - n // 3)]
    for _ in range(5):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(held.ids(a, b), ids[a:b])


def test_files_of_all_documents(spark):
    rng = random.Random(3)
    rows = [(i * 11 % 301, H.prose(rng, rng.randrange(40)), "en", "s") for i in range(301)] + [(1000 + i, t, "en", "s") for i, t in enumerate(AWKWARD)]
    files = token_ids.write(H.documents(spark, rows), PATH, scratch_path(spark, "test"), file_ids=3000)
    got = {r.doc_id: tuple(r)[1:] for r in token_ids.read(files).collect()}
    assert files.count() > 3
    at, want = 0, {}
    for doc_id, text, *_ in sorted(rows):
        ids = np.array(encoded(text), "<u4")
        want[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_odd_rows(spark):
    rows = H.odd_documents(random.Random(4))
    got = token_ids.round_trip(spark, H.documents(spark, rows, clashing=True)).collect()
    ids = [np.array(encoded(t), "<u4") for _, t, *_ in rows]
    want = sorted((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids) if r[0] is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [x[0] for x in want] + [None, None]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:]))
    assert token_ids.round_trip(spark, H.documents(spark, [])).count() == 0
