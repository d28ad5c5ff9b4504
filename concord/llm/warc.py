"""Web archives (WARC 1.1): one gzip member per record, written and read by Spark tasks.

Equal payloads are stored once; later pages become revisit records that name the first.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import store
from concord.llm.registry import query, table
from concord.session import materialise, scratch_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"<urn:x-page:(-?\d+|none)>")


def with_record_types(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to`` per page.

    Of the pages with an equal payload of at least ``least_bytes`` bytes, that with the smallest
    page_id is a response and the others revisit it. A null payload is empty. Rows that repeat the
    smallest page_id are responses too; a page without an id revisits any that has one, and is a
    response where none has. Only payloads that occur again enter the join, from a table of their own,
    so that adaptive execution can split a payload that many pages share.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    shaped = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    again = materialise(
        shaped.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("d", "first"),
        "payloads",
    )
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return shaped.join(again, F.col("payload_digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """The bytes of one record; a revisit holds the HTTP head, with the payload's length, alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, END])


def write(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the rows of ``with_record_types`` as archives of about ``file_bytes``; one row per file.

    Returns ``file, records``, of committed tasks alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, count = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "records": count}], _FILES)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in _WRITTEN)):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, size, count = store.new_name(folder, ".warc.gz"), 0, 0
                    out = store.writer(name)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, kind, refers_to, date)) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(pages.select(*_WRITTEN).mapInArrow(task, "file string, records long"), "archives")


_WRITTEN = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
_FILES = pa.schema([("file", pa.string()), ("records", pa.int64())])


class Damaged(ValueError):
    """An archive that ends early, or whose framing or digests do not hold."""


def records(stream, chunk: int = 1 << 18) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record, read in order with memory for one record and one chunk."""
    left, ended = b"", False

    def more() -> bytes:
        nonlocal ended
        got = stream.read(chunk)
        ended = not got
        return got

    while True:
        if not left and not (left := more()):
            return
        unpack, got, fields, body, length = zlib.decompressobj(31), bytearray(), None, 0, 0
        while not unpack.eof:
            if not left and not (left := more()):
                raise Damaged("the archive ends within a record")
            try:
                got += unpack.decompress(left, chunk)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if fields is None and (at := got.find(END)) >= 0:
                lines = bytes(got[:at]).split(b"\r\n")
                if lines[0] != VERSION:
                    raise Damaged(f"not a record: {lines[0][:40]!r}")
                fields = dict(x.split(b": ", 1) for x in lines[1:])
                body, length = at + 4, int(fields[b"Content-Length"])
            if fields is not None and len(got) > body + length + len(END):
                raise Damaged("a record is longer than its Content-Length")
        if fields is None or len(got) != body + length + len(END) or got[body + length :] != END:
            raise Damaged("a record and its Content-Length disagree")
        yield fields, bytes(got[body : body + length])


def checked(fields: dict[bytes, bytes], block: bytes) -> dict:
    """A record as a row, after its digests were verified."""
    if hashlib.sha256(block).hexdigest().encode() != fields[b"WARC-Block-Digest"].removeprefix(b"sha256:"):
        raise Damaged("block digest")
    head, _, payload = block.partition(END)
    length, kind = int(re.search(rb"Content-Length: (\d+)", head)[1]), fields[b"WARC-Type"].decode()
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise Damaged("payload digest")
    number = lambda x: None if x is None or (m := _ID.fullmatch(x)[1]) == b"none" else int(m)
    uri = fields.get(b"WARC-Target-URI")
    return {
        "page_id": number(fields[b"WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": number(fields.get(b"WARC-Refers-To")), "target_uri": uri and uri.decode(), "payload": payload if kind == "response" else None,
    }


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()),
])


def read(files: DataFrame, payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives in column ``file``, each archive by one task, in order.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri`` and, if asked for,
    ``payload`` (null for revisits). A damaged archive raises; no record is skipped.
    """
    schema = _READ if payload else _READ.remove(len(_READ) - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.reader(name) as stream:
                    for fields, block in records(stream):
                        row = checked(fields, block)
                        if not payload:
                            del row["payload"]
                        rows.append(row)
                        size += len(block) if payload else 500
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInArrow(task, kinds + (", payload binary" if payload else ""))


def dangling(rows: DataFrame) -> DataFrame:
    """Revisits whose response is missing, or has another digest or length."""
    keys = ["payload_digest", "payload_bytes"]
    asked = rows.filter("record_type = 'revisit'").select("refers_to", *keys).distinct()
    held = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *keys)
    return asked.join(held, ["refers_to", *keys], "left_anti")


def round_trip(spark: SparkSession, pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    files = write(with_record_types(pages), scratch_path(spark, "warc"))
    return read(files, payload)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q"""


@query("op1_warc", _SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri")
