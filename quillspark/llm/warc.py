"""WARC archives: one gzip member per record, read back sequentially.

Writing: a record per page; pages with a payload seen at a smaller page_id become revisits. Executors
stream the members to files of the shared folder through Spark's own writer. Reading: each archive is
inflated incrementally, framed by Content-Length, and every payload digest is verified.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, prepare, read_table, same

#: Bytes from which an archive is closed, bytes inflated at a time.
ARCHIVE, CHUNK = 1 << 24, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: gzip ends with the length mod 2**32, so its last byte is 0 below this length.
SHORT = 1 << 24
FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    return int(x) if (x := urn.removeprefix("<urn:x-page:").removesuffix(">")) else None


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(f"WARC/1.1\r\n{head}\r\n".encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """The gzip member of a page: a response, or a revisit of page `first`. It ends with a zero byte."""
    headers = [("WARC-Record-ID", _urn(page)), ("WARC-Date", date), ("WARC-Target-URI", quote(url or _urn(page)[1:-1], safe="!#$&'()*+,/:;=?@[]~%-._")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        member = _member("response", headers, http + payload)
    else:
        member = _member("revisit", [*headers, ("WARC-Refers-To", _urn(first)), ("WARC-Profile", PROFILE)], http)
    if member[-1]:  # a record of 16 MiB or more; a short one after it ends with a zero byte
        member += _member("metadata", [("WARC-Record-ID", f"<urn:x-page-note:{'' if page is None else page}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"")
    return member


class _Stream:
    """Inflated bytes of consecutive gzip members, a chunk at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.inflate, self.ready = memoryview(data), 0, None, b""

    def more(self) -> bool:
        """Inflates another piece of the member; False at its end."""
        while not self.inflate.eof:
            fed = self.inflate.unconsumed_tail
            if not fed:
                fed = bytes(self.data[self.at : self.at + CHUNK])
                self.at += len(fed)
                if not fed:
                    raise ValueError("the archive ends within a member")
            if piece := self.inflate.decompress(fed, CHUNK):
                self.ready += piece
                return True
        return False

    def open(self) -> bool:
        """Begins the next member; False at the end of the archive."""
        if self.inflate is not None:
            self.at -= len(self.inflate.unused_data)
        if self.at >= len(self.data):
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def head(self) -> list[str]:
        """Lines up to an empty one."""
        while b"\r\n\r\n" not in self.ready:
            if not self.more():
                raise ValueError("a header has no end")
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return head.decode().split("\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def read_archive(data: bytes, payloads: bool = False) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record."""
    stream = _Stream(data)
    while stream.open():
        first, *lines = stream.head()
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _fields(lines)
        kind, length, kept = head["warc-type"], int(head["content-length"]), []
        if kind == "metadata":
            for _ in stream.take(length):
                pass
        else:
            lines, sha = stream.head()[1:], hashlib.sha1()  # noqa: S324  the format's digest
            size = int(_fields(lines)["content-length"])
            if kind == "response":
                for piece in stream.take(size):
                    sha.update(piece)
                    if payloads:
                        kept.append(piece)
                if f"sha1:{base64.b32encode(sha.digest()).decode()}" != head["warc-payload-digest"]:
                    raise ValueError(f"wrong payload digest in {head['warc-record-id']}")
            row = (_page(head["warc-record-id"]), size, head["warc-payload-digest"].removeprefix("sha1:"), kind, _page(head["warc-refers-to"]) if kind == "revisit" else None)
            yield (*row, b"".join(kept)) if payloads else row
        if b"".join(stream.take(4)) != b"\r\n\r\n" or stream.ready or stream.more():
            raise ValueError("a record doesn't end where its member ends")


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html) to archives under path, each a file of whole gzip members.

    An archive ends with the record that takes it to ARCHIVE bytes, so a task holds that and one record.

    Null html is an empty payload, null urls get a urn. Among equal payloads of `least` bytes or more the
    smallest page_id is the response, other ids revisit it; rows that repeat that id are responses too, and
    rows without an id revisit it. An empty table writes no record. Other columns are not archived.
    """
    prepare(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("sha").alias("of"), "first")
    joined = rows.join(firsts, (rows["sha"] == firsts["of"]) & (F.octet_length("html") >= least), "left")
    joined = joined.select("page_id", "url", "html", "sha", F.when(~same(F.col("page_id"), F.col("first")), F.col("first")).alias("first"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], ["archive"])
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):  # a payload at a time
                page, url, html, sha, first = (row.column(c).cast(pa.binary())[0].as_py() if c == 2 else row.column(c)[0].as_py() for c in range(5))
                held += record(page, url, html, base64.b32encode(bytes.fromhex(sha)).decode(), first)
                if len(held) >= ARCHIVE:
                    yield out()
                    held.clear()
        if held:
            yield out()

    # a row is an archive and a file; the text writer puts back the zero byte with which each member ends
    made = joined.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, each archive read in sequence by one task, CHUNK bytes inflated at a time.

    Archives of write() have ARCHIVE bytes and a record at most; of others a task holds one at a time.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = read_archive(data.as_py())
                while rows := [*itertools.islice(found, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back, one row a page."""
    path = new_folder(spark, "warc")
    write(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path)


OP9_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - i % 4 * 5)::INTEGER) & 31) + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)"""
