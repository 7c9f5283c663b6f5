"""A content-addressed archive of web pages.

``payloads`` holds the bytes of every payload once, under its SHA-256, which is verified when they are stored and when
they are read; ``heads`` holds the exact header bytes of every record.  Joins of both give the records back; they are
written as WARC/1.1 files and read from them.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, shared_folder, written

#: Equal payloads of this many bytes are stored in one response, which the others revisit.
LEAST_REVISIT = 1000
#: Payload bytes of a file; a longer record is a file's only one but for chance.
FILE_BYTES = 32 << 20
#: A digest that over 1/HOT_SHARE of all records share is joined by broadcast: fewer than HOT_SHARE digests can be.
HOT_SHARE = 1024
#: Copies of one record that are numbered in one row before the rows are dealt again.
COPY_BLOCK = 4096
#: What ends a record; fixed by the format, as the field names are.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id string, record_type string, refers_to_id string, refers_to string, named_digest string, head binary, payload binary"


@dataclass
class Archive:
    """``heads(record_id, page_id, record_type, sha256, bytes, refers_to, head)`` and ``payloads(sha256, sha1, bytes, n, first_page, first_url, payload)``."""

    heads: DataFrame
    payloads: DataFrame
    least: int
    date: str


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit("").cast("binary"))


def _uuid(digest: Column) -> Column:
    """A name-based record id from a SHA-256 in hex: version 8, variant 2."""
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def _field(name: str, value: Column) -> Column:
    """A header line, absent where the value is null; control characters of the value are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), "\x00", "%00")
    return F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))


def joined_by_digest(many: DataFrame, once: DataFrame, on: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``once``, which has one row a key and the number ``n`` of rows of ``many`` that hold it.

    Keys of over 1/HOT_SHARE of the ``total`` rows, fewer than HOT_SHARE in number, are broadcast, so the largest group
    of copies stays spread over the tasks that hold it; all other keys are shuffled.
    """
    hot = once.where(F.col("n") * HOT_SHARE > total).drop("n")
    cold = once.where(F.col("n") * HOT_SHARE <= total).drop("n")
    return many.join(F.broadcast(hot), on).unionByName(many.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def archived(pages: DataFrame, least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Stores ``pages(page_id, url, html)``: a record for each row, each different payload once.

    Null html is an empty payload, a null url gives no target; rows that repeat are records of their own.  Of equal
    payloads of ``least`` bytes the one with the largest page_id is the response (nulls are smallest, ties go by the
    largest url, then to any one of equal rows), and the others revisit it.  Other columns are left out; an empty table
    gives an empty archive.  Payloads meet by digest in each task before they are shuffled.
    """
    rows = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"))
    source = F.struct(F.col("page_id").isNotNull(), "page_id", F.col("url").isNotNull(), "url")
    stored = rows.groupBy("sha256").agg(
        F.count("*").alias("n"),
        F.max(source).alias("source"),
        F.min("bytes").alias("bytes"),
        F.max("bytes").alias("most"),
        F.min(F.xxhash64("payload")).alias("check_low"),
        F.max(F.xxhash64("payload")).alias("check_high"),
        F.first("payload").alias("payload"),
    )
    same = (F.col("bytes") == F.col("most")) & (F.col("check_low") == F.col("check_high"))
    stored = written(
        stored.select(
            "sha256", F.sha1("payload").alias("sha1"), "bytes", "n",
            F.col("source.page_id").alias("first_page"), F.col("source.url").alias("first_url"),
            F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"),
        ),
        "payloads",
    )

    # equal rows are one row with their number, so records are numbered without a window over them
    records = written(rows.drop("payload", "bytes").groupBy("page_id", "url", "sha256").agg(F.count("*").alias("copies")), "records")
    total = records.agg(F.sum("copies")).first()[0] or 0
    records = joined_by_digest(records, stored.drop("payload"), "sha256", total)
    blocks = F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / COPY_BLOCK).cast("int"))).alias("block")
    many = records.where(F.col("copies") > COPY_BLOCK).select("*", blocks).repartition("sha256", "block")
    records = records.where(F.col("copies") <= COPY_BLOCK).withColumn("block", F.lit(0)).unionByName(many)
    copy = F.explode(F.sequence(F.col("block") * COPY_BLOCK, F.least((F.col("block") + 1) * COPY_BLOCK, "copies") - 1)).alias("copy")
    heads = with_heads(records.select("*", copy), least, date).select("record_id", "page_id", "record_type", "sha256", "bytes", "refers_to", "head")
    return Archive(written(heads, "heads"), stored, least, date)


def with_heads(records: DataFrame, least: int, date: str) -> DataFrame:
    """Record ids, types and exact header bytes of ``records(page_id, url, copy, sha256, bytes, first_page, first_url)``."""

    def identity(page: str, url: str, copy: Column) -> Column:
        parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (page, url)]
        return F.sha2(F.concat_ws("\x00", *parts, "sha256", copy.cast("string")), 256)

    is_first = (F.col("copy") == 0) & F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    revisits = (F.col("bytes") >= least) & ~is_first
    when = lambda value: F.when(revisits, value)
    records = records.select(
        "*",
        _uuid(identity("page_id", "url", F.col("copy"))).alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        when(_uuid(identity("first_page", "first_url", F.lit(0)))).alias("refers_to_id"),
        when(F.col("first_page")).alias("refers_to"),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.char_length(http) + F.when(revisits, 0).otherwise(F.col("bytes"))
    fields = [
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Page-ID", F.url_encode(F.col("page_id").cast("string"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha256"))),
        _field("WARC-Profile", when(F.lit(PROFILE))),
        _field("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))),
        _field("WARC-Refers-To-Page-ID", F.url_encode(F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", block.cast("string")),
    ]
    return records.withColumn("head", F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(f, F.lit("")) for f in fields], F.lit("\r\n"), http))


def verified(payloads: DataFrame) -> DataFrame:
    """The stored payloads; one whose bytes don't give its digest any more raises an error."""
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    return payloads.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))))


def originals(archive: Archive) -> DataFrame:
    """Every record with its exact header bytes and its whole payload, revisits too, by a join on the digest."""
    total = archive.heads.count()
    return joined_by_digest(archive.heads.drop("bytes"), verified(archive.payloads).select("sha256", "sha1", "bytes", "n", "payload"), "sha256", total)


def write_files(archive: Archive, path: str, compression: str = "gzip") -> str:
    """Writes the records as WARC files of about FILE_BYTES: a response with its payload, a revisit without.

    The one response of a payload that others revisit is written where its payload lies: its header follows from the
    payload's row.  Only payloads below ``archive.least`` bytes, of which any record may be a response, are joined.
    Spark's text writer ends each record with END, so that its commit keeps whole files only, also when executors are lost.
    """
    bytes_, total = (archive.payloads.agg(F.sum("bytes")).first()[0] or 0), archive.heads.count()
    payloads, large = verified(archive.payloads), F.col("bytes") >= archive.least
    first = payloads.where(large).select("sha256", "bytes", "first_page", "first_url", "payload", F.col("first_page").alias("page_id"), F.col("first_url").alias("url"), F.lit(0).alias("copy"))
    first = with_heads(first, archive.least, archive.date)
    rest = joined_by_digest(archive.heads.where(~large).drop("bytes"), payloads.where(~large).select("sha256", "n", "payload"), "sha256", total)
    lines = [r.select(F.concat(F.col("head").cast("binary"), F.col("payload")).cast("string").alias("value")) for r in (first, rest)]
    lines = lines[0].unionByName(lines[1]).unionByName(archive.heads.where("record_type = 'revisit'").select(F.col("head").alias("value")))
    most = max(1, FILE_BYTES * max(total, 1) // max(bytes_ + 1000 * total, 1))
    lines.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(path)
    return path


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*([^\r\n]*)")


def parse(raw: bytes) -> Iterator[dict]:
    """Records of one file's bytes: lengths are taken from the headers, so a payload may hold any bytes."""
    at = 0
    while at < len(raw):
        body = raw.find(b"\r\n\r\n", at) + 4
        if not raw.startswith(b"WARC/1.", at) or body < 4:
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.decode(errors="replace") for k, v in _FIELD.findall(raw, at, body)}
        end = body + int(_LENGTH.search(raw, at, body)[1])
        if end + 4 > len(raw) or raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        http = raw.find(b"\r\n\r\n", body, end) + 4 if fields.get(b"content-type", "").startswith("application/http") else body
        revisit = fields[b"warc-type"] == "revisit"
        yield {
            "record_id": fields[b"warc-record-id"].strip("<>"),
            "page_id": fields.get(b"warc-page-id"),
            "record_type": fields[b"warc-type"],
            "refers_to_id": fields[b"warc-refers-to"].strip("<>") if revisit else None,
            "refers_to": fields.get(b"warc-refers-to-page-id"),
            "named_digest": fields.get(b"warc-payload-digest"),
            "head": raw[at:http],
            "payload": None if revisit else raw[http:end],
        }
        at = end + 4


def _parsed(batches):
    schema = pa.schema([(n.split()[0], pa.binary() if n.endswith("binary") else pa.string()) for n in RECORD.split(", ")])
    for batch in batches:
        for content in batch["content"]:
            raw, rows, size = content.as_py(), [], 0
            for row in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                rows.append(row)
                size += len(row["head"]) + len(row["payload"] or b"")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files of a folder, of one or many gzip members or plain; a revisit's payload is null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_map(files, _parsed, RECORD)


def resolved(records: DataFrame, page_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: each record with what its full payload gives.

    A response's digests are taken from the bytes that were read; its SHA-256 must be the one that its header names.  A
    revisit has those of the response that it refers to.
    """
    payload = F.col("payload")
    differs = F.col("named_digest").startswith("sha256:") & (F.col("named_digest") != F.concat(F.lit("sha256:"), F.sha2(payload, 256)))
    digest = F.when(differs, F.raise_error(F.lit("payload and header differ"))).otherwise(F.sha1(payload))
    rows = written(records.select("record_id", "page_id", "record_type", "refers_to_id", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"), digest.alias("payload_digest")), "read-records")
    page = lambda c: F.url_decode(c).cast(page_type).alias(c)
    columns = [page("page_id"), F.col("payload_bytes"), F.col("payload_digest"), F.col("record_type"), page("refers_to")]
    own, others = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    asked = written(others.groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("n")), "referred")
    found = own.join(asked, "record_id").select(F.col("record_id").alias("refers_to_id"), "payload_bytes", "payload_digest", "n")
    back = joined_by_digest(others.drop("payload_bytes", "payload_digest"), found, "refers_to_id", others.count())
    return own.select(*columns).unionByName(back.select(*columns))


def archive_report(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archives ``pages``, writes the records as WARC files, reads them back and resolves them: a row for each page."""
    spark = pages.sparkSession
    path = write_files(archived(pages, least), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return resolved(read_files(spark, path), pages.schema["page_id"].dataType.simpleString())
