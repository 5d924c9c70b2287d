"""WARC archives: written with segments and revisits, read back with segments put together.

Writing: pages with equal payloads (one SHA-1) are found by a partial aggregation over
digests; only digests that occur more than once go on, and one join marks the rows that
revisit. Every page becomes an HTTP response in chunked framing, cut into a first record and
continuation records where it is longer than ``segment_bytes``. Spark's text writer stores
the records, because the two line ends that close a WARC record serve as its line separator;
so the files (gzip) are committed like any other output of a job.

Reading: files come through ``binaryFile`` and are unpacked as streams. Records without
segments are decoded where they are read. Segments are grouped by the id of their origin,
sorted by number and checked against the total length before the chunked framing is undone;
nothing else is shuffled.

Defined results
* A null html is an empty payload; a null url leaves out the target; a null page_id leaves out the page.
* Of equal payloads of at least ``min_bytes`` the smallest page_id is the response. Rows that
  repeat page_id and payload are all responses, or all revisits. Rows without page_id come after all others.
* ``status`` of a read record: ok, missing_segment, bad_length, bad_framing or bad_digest. An
  archive without records gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, shared_path, stored

END = "\r\n\r\n"
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = ("record_id string, record_type string, page_id long, target_uri string, refers_to_id string, header_digest string, "
          "origin_id string, segment int, total_length long, block binary")
PAYLOAD = ("record_id string, record_type string, page_id long, target_uri string, refers_to_id string, payload binary, "
           "payload_bytes long, payload_digest string, status string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same page and payload have the same id in any run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest(), version=4)}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i:i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = (f"{k}: {re.sub(r'[\x00-\x1f]+', ' ', str(v))}\r\n" for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(clean) + "\r\n").encode("utf-8", "replace")


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisits: bool,
                 segment_bytes: int) -> list[bytes]:
    """The WARC records of one page, without the separator that follows each."""
    digest = base32_sha1(payload)
    rid = record_id(page_id, digest)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    if revisits:
        block = HTTP
        return [_head([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *about,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(first, digest)), ("Content-Type", "application/http; msgtype=response"),
                       ("Content-Length", len(block))]) + block]
    block = HTTP + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        return [_head([("WARC-Type", "response"), ("WARC-Record-ID", rid), *about, kind, ("Content-Length", len(block))]) + block]
    cuts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_head([("WARC-Type", "response"), ("WARC-Record-ID", rid), *about, kind, ("WARC-Segment-Number", 1),
                  ("Content-Length", len(cuts[0]))]) + cuts[0]]
    for number, cut in enumerate(cuts[1:], 2):
        out.append(_head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}/{number}>"), ("WARC-Date", DATE),
                          ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", number),
                          ("WARC-Segment-Total-Length", len(block) if number == len(cuts) else None),
                          ("Content-Length", len(cut))]) + cut)
    return out


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    digest = F.sha1("payload")
    firsts = stored(rows.filter(F.length("payload") >= min_bytes).groupBy(digest.alias("d"))
                    .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                    .filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "warc-firsts")
    marked = rows.join(firsts, digest == F.col("d"), "left").withColumn(
        "revisits", F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 200):
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "revisits")]
            records = [r for row in zip(*columns, strict=True) for r in page_records(*row, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    (marked.select("page_id", "url", "payload", "first", "revisits").mapInArrow(run, "record binary")
     .select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse(stream) -> Iterator[tuple]:
    """Records of one unpacked archive, as the columns of RECORD."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head.get("content-length", 0)))

        def number(name, head=head):
            return int(head[name]) if name in head else None

        yield (head.get("warc-record-id"), head.get("warc-type"), number("x-page-id"), head.get("warc-target-uri"),
               head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               head.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block)


NAMES = [x.split()[0] for x in RECORD.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def _parse(segments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            for content in b.column("content").to_pylist():
                rows, held = [], 0
                with gzip.open(io.BytesIO(content)) as stream:
                    for row in parse(stream):
                        if (row[7] is not None) == segments:
                            rows.append(row)
                            held += len(row[9])
                        if held > 4_000_000:
                            yield _batch(rows, NAMES, TYPES)
                            rows, held = [], 0
                yield _batch(rows, NAMES, TYPES)
    return run


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _payload(kind: str, block: bytes, digest: str | None) -> tuple[bytes | None, str]:
    if kind != "response":
        return None, "ok"
    head, split, body = block.partition(b"\r\n\r\n")
    payload = body if b"transfer-encoding: chunked" not in head.lower() else dechunk(body)
    if not split or payload is None:
        return None, "bad_framing"
    return payload, "ok" if digest in (None, base32_sha1(payload)) else "bad_digest"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``parts`` (number, total length, block) in order, to payloads."""
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    for b in chunks(batches, 200):
        out = []
        for r in b.to_pylist():
            parts, total = [p["block"] for p in r["parts"]], next((p["total"] for p in r["parts"] if p["total"] is not None), None)
            numbers = [p["number"] for p in r["parts"]]
            block, payload = b"".join(parts), None
            if numbers != [None] and (numbers != list(range(1, len(numbers) + 1)) or total is None):
                status = "missing_segment"
            elif total is not None and len(block) != total:
                status = "bad_length"
            else:
                payload, status = _payload(r["record_type"], block, r["header_digest"])
            out.append((r["record_id"], r["record_type"], r["page_id"], r["target_uri"], r["refers_to_id"], payload,
                        None if payload is None else len(payload),
                        r["header_digest"] if payload is None else base32_sha1(payload), status))
        yield _batch(out, names, types)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of all archives under ``path``, with the columns of PAYLOAD.

    A revisit has no payload of its own; its digest is the one it was stored with."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    part = F.struct(F.col("segment").alias("number"), F.col("total_length").alias("total"), "block")
    about = ["record_id", "record_type", "page_id", "target_uri", "refers_to_id", "header_digest"]
    whole = files.mapInArrow(_parse(False), RECORD).filter(F.col("record_type").isin("response", "revisit")).select(*about, F.array(part).alias("parts"))
    # a group is one record, so it is as long as that; equal ids are equal records, and a segment then counts once
    pieces = (files.mapInArrow(_parse(True), RECORD)
              .groupBy(F.coalesce("origin_id", "record_id").alias("group_id"))
              .agg(F.array_sort(F.collect_set(part)).alias("parts"),
                   F.sum(F.when(F.col("origin_id").isNull(), 1).otherwise(0)).alias("heads"),
                   *(F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in about))
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("heads").cast("int")))))
              .withColumn("record_id", F.col("group_id")).select(*about, "parts"))
    return whole.unionByName(pieces).mapInArrow(_decode, PAYLOAD)


def warc_digest(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives, reads them back and returns per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to and status."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, min_bytes, segment_bytes)
    records = stored(read_warc(spark, path).drop("payload", "target_uri"), "warc-records")
    # what a revisit stands for is read from its response
    source = records.filter(F.col("record_type") == "response").groupBy(F.col("record_id").alias("s_id")).agg(
        F.first("page_id").alias("s_page"), F.first("payload_bytes").alias("s_bytes"), F.first("payload_digest").alias("s_digest"))
    source = stored(source, "warc-responses")
    return records.join(source, F.col("refers_to_id") == F.col("s_id"), "left").select(
        "page_id", F.coalesce("payload_bytes", "s_bytes").alias("payload_bytes"), F.coalesce("s_digest", "payload_digest").alias("payload_digest"),
        "record_type", F.col("s_page").alias("refers_to"),
        F.when(F.col("refers_to_id").isNotNull() & F.col("s_id").isNull(), "missing_response").otherwise(F.col("status")).alias("status"))
