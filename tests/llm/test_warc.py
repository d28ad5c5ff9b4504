import hashlib
import io
import random
import zlib

import pytest

from concord.llm import warc
from concord.session import scratch_path
from tests.llm import helpers as H

PAGES = "page_id long, url string, html string"


def odd_pages():
    long_ = "é" * 200_000 + "".join(random.Random(1).choice("abc \n") for _ in range(300_000))
    same, short = "<p>" + "x" * 120, "y" * 99
    return [
        (5, "http://a/1", same), (3, "http://a/2", same), (9, None, same), (None, "http://a/none", same), (3, "http://a/2", same),
        (10, "u", short), (11, "u", short), (12, "http://a/b c\r\nX: y", None), (13, "http://a", ""), (14, "http://a", long_), (None, None, None),
        (15, "z", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    ]


def expected(pages):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        revisit = len(payload) >= 100 and len([1 for _, _, h in pages if (h or "").encode() == payload]) > 1 and ids and page_id != min(ids)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    return out


def test_round_trip(spark):
    pages = odd_pages()
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 AS first", "'x' AS payload", "2 AS d")
    got = warc.round_trip(spark, df, payload=True)
    rows = got.collect()
    assert H.plain(tuple(r)[:5] for r in rows) == H.plain(expected(pages))
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in rows if r.record_type == "response")
    assert warc.dangling(got).count() == 0
    assert warc.dangling(got.filter("page_id <> 3 or page_id is null")).count() == 1


def test_files_are_cut_and_empty_tables(spark):
    df = warc.with_record_types(spark.createDataFrame([(i, "u", f"{i}" * 500) for i in range(40)], PAGES).coalesce(1))
    files = warc.write(df, scratch_path(spark, "test"), file_bytes=1000)
    assert files.count() > 5 and warc.read(files).count() == 40
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def _member(payload=b"body" * 50, **changed):
    raw = warc.record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), "response", None, "2000-01-01T00:00:00Z")
    for old, new in changed.get("swap", ()):
        raw = raw.replace(old, new)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_reader_by_any_chunk(chunk):
    archive = b"".join(_member(bytes([i]) * (i * 37)) for i in range(12))
    got = [warc.checked(*x) for x in warc.records(io.BytesIO(archive), chunk)]
    assert [x["payload"] for x in got] == [bytes([i]) * (i * 37) for i in range(12)]


@pytest.mark.parametrize("archive", [
    _member()[:-9], _member() + b"junk", _member(swap=[(b"bodybody", b"bodyBODY")]), _member(swap=[(b"WARC/1.1", b"WARC/9.9")]),
    _member(swap=[(b"Content-Length: 2", b"Content-Length: 1")]), zlib.compress(b"x"),
])
def test_damage_raises(archive):
    with pytest.raises(warc.Damaged):
        for x in warc.records(io.BytesIO(archive)):
            warc.checked(*x)
