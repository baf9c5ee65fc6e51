"""Content-addressed WARC archive.

A record is its header bytes (the WARC header, then the HTTP header where it has one), its payload bytes and its trailer
bytes. The archive keeps two tables: payloads, one row for each distinct payload under its SHA-256 (compressed), and
headers, one row for each record with the exact bytes around the payload and the payload's digest. A join of the two on
the digest gives back each record byte by byte.

Digests are verified twice: a digest that a record declares is compared with the one computed from its payload, and the
rows that share a digest must agree in length and in a second hash of another kind.

Defined results: a null payload counts as an empty one; empty payloads share one row like any other payload. Null urls
leave their header line out, null ids theirs. Repeated rows are records of their own that share a payload. Extra columns
of the input are ignored. No records give empty tables. Payloads are taken whole at any length. A file is read in time
proportional to its size; it is held in memory as it is stored (Spark reads files of up to 2 GB), its contents a record at a
time. What is damaged comes back as payloads without headers, up to the next record or gzip member.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

_CRLF = "\r\n"


@F.pandas_udf(BinaryType())
def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for payloads in batches:
        yield payloads.map(squeeze.compress)


@F.pandas_udf(BinaryType())
def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    open_up = zstandard.ZstdDecompressor()
    for payloads in batches:
        yield payloads.map(open_up.decompress)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as WARC response records: (record_id, header, payload, trailer, declared)."""
    payload = F.encode(F.coalesce(F.col("h").cast("string"), F.lit("")), "UTF-8")
    rows = common.pick(pages, i=id_col, u=url_col, h=html_col).select(F.col("i").cast("long").alias("record_id"), F.col("u").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("declared", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: response{_CRLF}"),
        F.coalesce(line("WARC-Target-URI", F.col("u")), F.lit("")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("record_id").cast("string"), F.lit(">"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("declared"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        line("Content-Length", (F.octet_length(http) + F.col("size")).cast("string")),
        F.lit(_CRLF),
    )
    return rows.select("record_id", F.encode(F.concat(head, http), "UTF-8").alias("header"), "payload", F.encode(F.lit(_CRLF * 2), "UTF-8").alias("trailer"), "declared")


def headers_table(rows: DataFrame) -> DataFrame:
    """(record_id, header, trailer, digest, declared_ok, record_digest): a row for each record, without payloads."""
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    whole = F.concat("header", "payload", "trailer")
    return rows.select("record_id", "header", "trailer", "digest", (F.col("declared").isNull() | (F.lower("declared") == F.col("digest"))).alias("declared_ok"), F.sha2(whole, 256).alias("record_digest"))


def payloads_table(rows: DataFrame) -> DataFrame:
    """(digest, payload, size, copies, first_id, verified): a row for each distinct payload, stored compressed."""
    common.tune(rows.sparkSession)
    # compressed before it is shuffled: the bytes that travel and are spilled are those that are stored
    rows = rows.select("record_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("second"), packed("payload").alias("payload"))
    found = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("size").alias("size"), F.max("size").alias("most"), F.min("second").alias("a"), F.max("second").alias("b"), F.count("*").alias("copies"), F.min("record_id").alias("first_id"))
    return found.select("digest", "payload", "size", "copies", "first_id", ((F.col("size") == F.col("most")) & (F.col("a") == F.col("b"))).alias("verified"))


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """headers with `record`, the original bytes, and what the payload's row says."""
    common.tune(headers.sparkSession)
    both = headers.join(payloads, "digest").withColumn("plain", unpacked("payload"))
    return both.withColumn("record", F.concat("header", "plain", "trailer")).drop("plain", "payload")


def archive_report(rows: DataFrame) -> DataFrame:
    """Archive the records, put each together again, and say for each whether it came back byte by byte."""
    back = reconstruct(headers_table(rows), payloads_table(rows))
    return back.select(
        "record_id",
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.octet_length("header").cast("long").alias("header_bytes"),
        "copies",
        F.col("first_id").alias("stored_from"),
        F.sha2("record", 256).alias("record_digest"),
        (F.col("declared_ok") & F.col("verified") & (F.sha2("record", 256) == F.col("record_digest"))).alias("exact"),
    )


# --- WARC files -----------------------------------------------------------------------------------------------


#: Bytes that are decompressed at a time: what follows a member in them is copied once for each member.
_STEP = 1 << 14
_MEMBER = b"\x1f\x8b\x08"
_BREAK = b"\r\n\r\n"
#: Where a record may begin behind damage: the version and the first field's name.
_NEXT = re.compile(rb"WARC/1\.[01]\r\n[A-Za-z][A-Za-z0-9-]{0,60}:")


def contents(data: bytes) -> Iterator[bytes]:
    """Stretches of a file's contents: of all members of a gzip file, or of the bytes themselves."""
    view, at = memoryview(data), 0
    if not data.startswith(_MEMBER):
        for low in range(0, len(view), 1 << 20):
            yield bytes(view[low : low + (1 << 20)])
        return
    while at < len(view):
        part = zlib.decompressobj(31)
        try:
            while not part.eof and at < len(view):
                piece = view[at : at + _STEP]
                yield part.decompress(piece)
                at += len(piece) - len(part.unused_data)
            yield part.flush()
        except zlib.error:
            after = data.find(_MEMBER, at + 1)
            after = len(view) if after < 0 else after
            yield bytes(view[at:after])
            at = after
        while at < len(view) and not view[at]:  # some writers fill up with zeros
            at += 1


def split_records(data: bytes | Iterator[bytes]) -> Iterator[tuple[int, bytes, bytes, bytes, str | None]]:
    """(offset, header, payload, trailer, declared SHA-256 in hex) of each record; the parts add up to all of data.

    Bytes that no record explains (a damaged header, a cut file) come back as the payload of a record without header, up to
    where the next record seems to begin.
    """
    source = iter((data,)) if isinstance(data, bytes) else data
    held, at = bytearray(), 0

    def more() -> bool:
        for stretch in source:
            if stretch:
                held.extend(stretch)
                return True
        return False

    def take(n: int) -> bytes:
        nonlocal at
        out = bytes(held[:n])
        del held[:n]
        at += len(out)
        return out

    while held or more():
        while len(held) < 5 and more():
            pass
        size, end = None, -1
        if held.startswith(b"WARC/"):
            seen = 0
            while (end := held.find(_BREAK, seen)) < 0:
                seen = max(0, len(held) - 3)
                if not more():
                    break
            size = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", held[:end]) if end >= 0 else None
        begin = at
        if size is None:
            seen = 1
            while not (found := _NEXT.search(held, seen)):
                seen = max(1, len(held) - 80)
                if not more():
                    break
            yield begin, b"", take(found.start() if found else len(held)), b"", None
            continue
        stop = end + 4 + int(size[1])
        while len(held) < stop and more():
            pass
        head, body = take(end + 4), take(stop - end - 4)
        if body.startswith(b"HTTP/") and (cut := body.find(_BREAK)) >= 0 and re.search(rb"(?im)^content-type:\s*application/http", head):
            head, body = head + body[: cut + 4], body[cut + 4 :]
        tail = 0
        while True:
            while held.startswith(b"\r\n", tail):
                tail += 2
            if len(held) - tail >= 2 or not more():
                break
        declared = re.search(rb"(?im)^warc-payload-digest:\s*sha256:([0-9a-f]{64})\s*$", head)
        yield begin, head, body, take(tail), declared[1].decode() if declared else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: (record_id, header, payload, trailer, declared, path, offset).

    record_id is a hash of path and offset. A file is read by one task, as gzip members can't be found otherwise.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, header, payload, trailer, declared in split_records(contents(content.as_py())):
                    key = int.from_bytes(sha256(f"{name}:{offset}".encode()).digest()[:8], "big", signed=True)
                    rows.append((key, header, payload, trailer, declared, name, offset))
                    held += len(payload)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, "record_id long, header binary, payload binary, trailer binary, declared string, path string, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64())
    names = ["record_id", "header", "payload", "trailer", "declared", "path", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_archive(rows: DataFrame, path: str) -> None:
    """The two tables under path."""
    payloads_table(rows).write.mode("overwrite").parquet(f"{path}/payloads")
    headers_table(rows).write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return reconstruct(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def oracle() -> str:
    """archive_report() of pages, in DuckDB's SQL."""
    return r"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages),
    h AS (SELECT *, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', size, chr(13), chr(10), chr(13), chr(10)) AS http FROM p),
    r AS (SELECT *, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
        CASE WHEN url IS NOT NULL THEN concat('WARC-Target-URI: ', url, chr(13), chr(10)) ELSE '' END,
        CASE WHEN page_id IS NOT NULL THEN concat('WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10)) ELSE '' END,
        'WARC-Payload-Digest: sha256:', digest, chr(13), chr(10), 'Content-Type: application/http; msgtype=response', chr(13), chr(10),
        'Content-Length: ', octet_length(encode(http)) + size, chr(13), chr(10), chr(13), chr(10), http) AS header FROM h)
    SELECT page_id AS record_id, digest AS payload_digest, size AS payload_bytes, octet_length(encode(header))::BIGINT AS header_bytes,
        count(*) OVER (PARTITION BY digest) AS copies, min(page_id) OVER (PARTITION BY digest) AS stored_from,
        sha256(concat(header, html, chr(13), chr(10), chr(13), chr(10))) AS record_digest, true AS exact
    FROM r
    """
