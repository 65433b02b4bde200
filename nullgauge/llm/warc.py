"""Web archives with revisit records.

Writing: headers (id, payload digest, payload length) are shuffled by digest, never payloads; of equal payloads the
smallest page id is the response, the others become revisit records that refer to it. Records are made by column
expressions and written by Spark's text sink, whose separator CR LF CR LF ends a record, so archives go to any file
system that Spark knows and a lost task's file is written again. A file holds about FILE_BYTES at most, or one record:
pages are written by size classes, each with so many records a file as its largest page allows.

Every record has a fresh header: the time of writing, an id of its own (made from the archive's name where revisits
must refer to it), and for revisits the target and date of the original. X-Page-ID carries the row's page_id.

Reading: files are parsed by their Content-Length fields; the digest of a response is computed again from its payload.
Revisits are joined to their responses, which must hold the same digest.

Defined results: a null html is an empty payload; a null url has no target field; rows with a null page_id take part
in groups but are never referred to; rows that share a response's page_id and payload are all responses, under one
record id; a page of any size that a string column can hold is one record; other columns aren't looked at; an empty
table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, use_checkpoints

#: Bytes and records that a file should hold at most, and the payload sizes that end a size class.
FILE_BYTES, RECORDS = 64_000_000, 5_000
CLASSES = [12_000, 200_000, 3_000_000, 50_000_000]
#: Bytes of a record's headers, about.
HEADER_BYTES = 800
#: Digest groups of several pages up to which the table of responses may be broadcast (about 60 bytes a row).
BROADCAST_GROUPS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Base-32 SHA-1 of a string's UTF-8 bytes: the digest's four 40-bit parts in base 32, then RFC 4648 letters."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, and refers_to and refers_to_url (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    headers = full.select("page_id", "url", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least_bytes)
    first_url = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"]
    groups = headers.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), first_url.alias("first_url"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL").select("payload_digest", "payload_bytes", "first_id", "first_url")
    groups = saved(groups)
    small = groups.count() <= BROADCAST_GROUPS
    out = full.join(F.broadcast(groups) if small else groups, ["payload_digest", "payload_bytes"], "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.withColumns({"refers_to": F.when(other, F.col("first_id")), "refers_to_url": F.when(other, F.col("first_url"))}).drop("first_id", "first_url")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(archive: str) -> Column:
    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def target(url: str) -> Column:
        return F.regexp_replace(url, "[\\x00-\\x20\\x7F]", "%20")

    revisit, page = F.col("refers_to").isNotNull(), F.col("page_id").cast("string")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    # only responses are referred to, so the ids of all other records may be drawn
    own = F.when(revisit | page.isNull(), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(_uuid(F.lit(archive), page, F.col("payload_digest")))
    original = F.when(revisit, _uuid(F.lit(archive), F.col("refers_to").cast("string"), F.col("payload_digest")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"), field("WARC-Record-ID", own), field("WARC-Date", now), field("WARC-Target-URI", target("url")),
        field("WARC-Profile", F.when(revisit, PROFILE)), field("WARC-Refers-To", original), field("WARC-Refers-To-Target-URI", target("refers_to_url")), field("WARC-Refers-To-Date", F.when(revisit, now)),
        field("X-Page-ID", page), field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes deduplicated archives of pages (page_id, url, html)."""
    rows = resolved(pages, least_bytes)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    held = pages.select(F.array_size(F.filter(F.array(*map(F.lit, CLASSES)), lambda edge: size > edge)).alias("class"), size.alias("size"))
    classes = sorted((r["class"], r["largest"]) for r in held.groupBy("class").agg(F.max("size").alias("largest")).collect())
    for k, largest in classes or [(0, 0)]:
        # the first class has no lower edge and the last no upper one
        inside = (F.col("payload_bytes") > (CLASSES[k - 1] if k else -1)) & (F.col("payload_bytes") <= largest)
        records = max(1, min(RECORDS, FILE_BYTES // (largest + HEADER_BYTES)))
        rows.filter(inside).select(_record(folder).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).mode("append").text(folder)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
RECORD_SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload string"


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive as tuples of RECORD_SCHEMA; a response whose digest doesn't hold is an error."""
    at = 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at) + 4
        head = {k.lower(): v for k, v in _FIELD.findall(content, at, body)}
        stop = body + int(head[b"content-length"])
        payload_at = content.index(b"\r\n\r\n", body) + 4
        http = {k.lower(): v for k, v in _FIELD.findall(content, body, payload_at)}
        kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        number = [int(head[f]) if f in head else None for f in (b"x-page-id", b"x-refers-to-page-id")]
        payload = content[payload_at:stop] if kind == "response" else None
        if payload is not None and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"payload digest of record {number[0]} doesn't hold")
        url = head.get(b"warc-target-uri")
        yield kind, number[0], url.decode() if url is not None else None, number[1], digest, len(payload) if payload is not None else int(http[b"content-length"]), payload.decode() if payload is not None else None
        at = stop + 4


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; without payloads only their headers leave the reader."""
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [r[: len(names)] for r in parse_archive(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, schema)


def with_originals(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the length of their response."""
    heads = records.select("record_type", "page_id", "refers_to", "payload_digest", "payload_bytes")
    first = heads.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    both = heads.join(first, ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives to a new folder beside the checkpoints and reads them back."""
    spark = pages.sparkSession
    folder = f"{use_checkpoints(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_bytes)
    return with_originals(read_archives(spark, folder, payloads=False))
