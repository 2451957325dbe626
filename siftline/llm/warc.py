"""WARC archives and the resolution of revisits.

Archives are written by Spark's text writer: a record's text is its value, and the two line breaks that end a record
are the line separator, so the files are WARC 1.1 (gzip by default) on any file system that Spark can write.  They
are read as binary files and parsed by Content-Length, never by searching payloads for separators.  A file holds at
most ``FILE_BYTES`` of records, or one larger record: a record must fit in a cell (2 GiB), as must its page's html.

Resolution shuffles headers only.  Records with equal payloads of at least ``least`` bytes meet by digest; the one with
the largest page id stays a response and the others become revisits of it.  The group's answer is aggregated before
the shuffle, so a payload that a third of all pages share costs one row a task.  Deduplicated archives are written
with fresh headers: record ids of their own, the time of the call, and references to the new ids.

Edge cases: null html counts as empty, null url is an empty target; line breaks in a url are percent-encoded; a null
page id never becomes the target while another is there; rows that repeat page id and payload are all responses or
all revisits; an empty table gives empty archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_documents, drop_path, forget, read, settle, work_path

CRLF = "\r\n"
#: Most bytes of a file before compression, and the size up to which records are of the smallest order.
FILE_BYTES, SMALLEST = 64 << 20, 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, record_type string, page_id long, uri string, digest string, payload_bytes long, refers_record string, sha256 string, payload binary"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def record_text(kind: Column, date: str) -> Column:
    """A record's text from the columns record_id, page_id, uri, digest, payload_bytes, payload, target_record and target_uri;
    ``kind`` is response or revisit.  Revisits hold the HTTP header and no payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = kind == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.col("target_record")), _line("WARC-Refers-To-Target-URI", F.col("target_uri")))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")),
    )


def _write(records: DataFrame, path: str, order: int, kind: Column, date: str, compression: str, file_bytes: int) -> None:
    most = max(1, int(file_bytes // (SMALLEST * 8**order)))
    records.select(record_text(kind, date).alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", most).text(f"{path}/size-{order}")


def write_archives(records: DataFrame, path: str, kind: Column, date: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> list[int]:
    """Write ``records`` below ``path``.  Each file is read as a whole, so records of one order of size share files of at most
    ``file_bytes`` (or of one larger record), in a folder an order of size: a scan for each order that occurs.  Returns the
    orders."""
    order = F.greatest(F.ceil(F.log(8.0, (F.col("payload_bytes") + 2 * F.octet_length("uri") + 1024) / SMALLEST)), F.lit(0)).cast("int")
    held = records.where(F.col("payload_bytes").isNotNull())
    orders = sorted(r[0] for r in held.select(order.alias("o")).distinct().collect()) or [0]  # a dozen at most
    for o in orders:
        _write(held.where(order == o), path, o, kind, date, compression, file_bytes)
    return orders


def pages_to_records(pages: DataFrame) -> DataFrame:
    p = as_documents(pages, {"page_id": "long", "url": "string", "html": "string"})
    html = F.coalesce("html", F.lit(""))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = p.select("page_id", uri.alias("uri"), html.alias("payload"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    named = F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "uri", "digest")
    return p.withColumns({"record_id": record_uuid(named), "target_record": F.lit(""), "target_uri": F.lit("")})


def record_uuid(named: Column) -> Column:
    """A record id that follows from what it names, so that a task that runs again writes the same one."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(named.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def fresh_id(record_id: Column) -> Column:
    """The id of the record that takes a record's place in deduplicated archives."""
    return record_uuid(F.concat(F.lit("deduplicated\0"), record_id))


def parse_archive(data: bytes):
    """Yield (headers with lower-case names, block) of each record; gzip, in one member or many, is recognised."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            one = zlib.decompressobj(31)
            parts.append(one.decompress(data) + one.flush())
            data = one.unused_data
        data = b"".join(parts)
    view, at = memoryview(data), 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:stop].decode("utf-8").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        begin = stop + 4
        end = begin + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, view[begin:end]
        at = end + 4


def _parsed(with_payload: bool):
    def run(batches):
        length = re.compile(rb"(?i)\r\ncontent-length: *(\d+)\r\n")
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse_archive(content.as_py()):
                    block = bytes(block)
                    stop = block.index(b"\r\n\r\n") + 4
                    payload, kind = block[stop:], head["warc-type"]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                    rows.append((head["warc-record-id"], kind, int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], digest, int(length.search(block, 0, stop)[1]),
                                 head.get("warc-refers-to"), hashlib.sha256(payload).hexdigest() if kind == "response" else None, payload if with_payload else None))
                    size += len(payload) * with_payload
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives below ``path``; response payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), PARSED)


def resolve_revisits(spark, source: str, target: str, orders: list[int], date: str, least: int = 1000, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Read the archives at ``source`` and write deduplicated ones to ``target``; ``orders`` of size have a folder each in both."""
    heads = settle(read_archives(spark, source).drop("payload"), "heads")
    same = ["digest", "sha256", "payload_bytes"]
    groups = heads.where(F.col("payload_bytes") >= least).groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id", "uri")).alias("top")
    ).where("n > 1")
    revisits = heads.join(groups, same).where(~F.col("page_id").eqNullSafe(F.col("top.page_id")))
    revisits = settle(revisits.select("record_id", F.col("top.record_id").alias("target_record"), F.col("top.uri").alias("target_uri")).distinct(), "revisits")
    small = revisits.count() * 512 <= BROADCAST_BYTES
    for o in orders:
        full = read_archives(spark, f"{source}/size-{o}", with_payload=True).drop("refers_record")
        full = full.join(F.broadcast(revisits) if small else revisits, "record_id", "left")
        full = full.withColumns({"record_id": fresh_id(F.col("record_id")), "target_record": fresh_id(F.col("target_record"))})
        _write(full, target, o, F.when(F.col("target_record").isNotNull(), "revisit").otherwise("response"), date, compression, file_bytes)
    forget(heads, revisits)


def dedup_pages(pages: DataFrame, least: int = 1000, date: str | None = None) -> tuple[DataFrame, str]:
    """Write ``pages`` as archives, resolve revisits, and read the deduplicated archives: their records and their folder.
    Records carry ``date``, or the time of the call."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw, clean = work_path(spark, "warc-raw"), work_path(spark, "warc")
    orders = write_archives(pages_to_records(pages), raw, F.lit("response"), date)
    resolve_revisits(spark, raw, clean, orders, date, least)
    back = settle(read_archives(spark, clean).drop("payload", "sha256"), "records")
    drop_path(spark, raw)
    original = back.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("record_id", "refers_record")
    revisits = back.where("record_type = 'revisit'").join(original, "refers_record", "left")
    responses = back.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(revisits), clean


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    records, _ = dedup_pages(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM t
"""
