"""WARC archives with revisit records.

Archives are written by Spark's text sink, one record a row, into files of a bounded number of records and bytes, and
read by the binary-file source, so any file system that Spark knows will do.  Before writing, the headers
alone (digest, size, id) are shuffled by payload digest; every row whose payload an original already holds
becomes a revisit record that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

#: Payloads below this many bytes are always written whole.
MIN_REVISIT_BYTES = 1000
#: Archives are read whole, so they hold at most so many records and, but for a single larger record, bytes.
RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_SUFFIX = "<tag:archive.example,2024:page/", ">"
CRLF = "\r\n"
END = CRLF + CRLF
READ_SCHEMA = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, stated_digest string, refers_to long, payload binary"


def payload_headers(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, uri, payload_bytes and payload_digest of every row; the payload itself stays behind."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("uri") if "url" in pages.columns else F.lit(None).cast("string").alias("uri"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )


def originals(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """payload_digest, ``original``, the largest page_id, and its uri, of every payload that occurs more than once."""
    return (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "uri")).alias("top"))
        .where(F.col("copies") > 1)
        .select("payload_digest", F.col("top.page_id").alias("original"), F.col("top.uri").alias("original_uri"))
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The revisit records among ``headers``: page_id, payload_digest, refers_to and refers_uri.

    Headers meet their originals by payload digest.  A group of copies of any size costs one row for each
    task before the shuffle, and Spark splits a large one in the join.
    """
    found = originals(headers, min_bytes)
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    return (
        long.join(found, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("original")))
        .select("page_id", "payload_digest", F.col("original").alias("refers_to"), F.col("original_uri").alias("refers_uri"))
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(ID_SUFFIX))


def _safe(uri: Column) -> Column:
    """Control characters and spaces percent-encoded, so no header line can be broken."""
    return F.regexp_replace(F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "%0A"), " ", "%20")


def record_text(page_id: Column, uri: Column, html: Column, digest: Column, refers_to: Column, refers_uri: Column, date: str) -> Column:
    """One WARC/1.1 record as a string, without the two line ends that follow it.

    The block is an HTTP response header and, but for revisits, the payload.  A null uri leaves its line out.
    """
    body = F.coalesce(html, F.lit(""))
    size = F.octet_length(body)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(END))
    revisit = refers_to.isNotNull()
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(page_id)),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _safe(uri)), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(
            _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(refers_to)),
            F.coalesce(_line("WARC-Refers-To-Target-URI", _safe(refers_uri)), F.lit("")), _line("WARC-Refers-To-Date", F.lit(date)),
        )).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, F.lit("")).otherwise(body),
    )


def _number_archives(records_per_file: int, bytes_per_file: int):
    """Adds ``archive``: a task's records are counted off, and an archive ends where the next record would exceed its bounds."""

    def run(batches):
        archive, records, held = 0, 0, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int32)
            for i, size in enumerate(pc.binary_length(batch.column(0)).to_pylist()):
                if records and (records == records_per_file or held + size > bytes_per_file):
                    archive, records, held = archive + 1, 0, 0
                numbers[i] = archive
                records, held = records + 1, held + size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers)], ["value", "archive"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> str:
    """Write one record for each row of ``pages`` (page_id, url, html) as gzip archives below ``path``.

    Null html is an empty payload.  Rows with the largest page_id of a repeated payload are responses, also if
    several rows have that id; a null page_id is smaller than any.  Rows of one id have one record id.  ``date`` is that of all
    headers, by default the time of writing.  An archive holds at most RECORDS_PER_FILE records and BYTES_PER_FILE bytes of
    them before compression; a record that is larger by itself has an archive of its own, and others are not affected.  Other
    columns are ignored; an empty table gives archives without records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = payload_headers(pages)
    revisits = resolve_revisits(headers, min_bytes).distinct().toDF("rid", "rdigest", "refers_to", "refers_uri")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.col("html").cast("string").alias("html"),
        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"),
    )
    # page_id is all but unique, so this join has no hot key.
    joined = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["rid"]) & (rows["digest"] == revisits["rdigest"]), "left")
    records = joined.select(record_text(F.col("page_id"), F.col("uri"), F.col("html"), F.col("digest"), F.col("refers_to"), F.col("refers_uri"), date).alias("value"))
    numbered = records.mapInArrow(_number_archives(RECORDS_PER_FILE, BYTES_PER_FILE), "value string, archive int")
    numbered.write.partitionBy("archive").option("compression", "gzip").option("lineSep", END).text(path)
    return path


def parse_archive(data: bytes):
    """The records of one archive: header fields in lower case, and the block."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if version in (b"\r\n", b"\n"):
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _page_of(record_id: str | None) -> int | None:
    if not record_id or not record_id.startswith(ID_PREFIX):
        return None
    inner = record_id[len(ID_PREFIX) : -len(ID_SUFFIX)]
    return None if inner == "null" else int(inner)


def _record_row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, size = fields["warc-type"], len(payload)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    whole = kind == "response"
    return (
        _page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, size, hashlib.sha1(payload).hexdigest() if whole else stated, stated,
        _page_of(fields.get("warc-refers-to")), payload if with_payload and whole else None,
    )


def _records(with_payload: bool):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(NAMES, zip(*rows, strict=True), strict=True)}, schema=ARROW)

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_archive(cell.as_buffer().to_pybytes()):
                    rows.append(_record_row(fields, block, with_payload))
                    held += len(block) if with_payload else 0
                    if held > 1 << 25:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


NAMES = [x.split()[0] for x in READ_SCHEMA.split(", ")]
_ARROW_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
ARROW = pa.schema([(x.split()[0], _ARROW_TYPES[x.split()[1]]) for x in READ_SCHEMA.split(", ")])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path``.

    Digest and size of a response are taken from the bytes read; a revisit states those of the payload it stands
    for.  ``payload`` is null for revisits.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_records(with_payload), READ_SCHEMA)


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Read archives, give revisits their original's payload, and write them anew without repeated payloads."""
    records = read_archives(spark, source)
    have = records.where(F.col("record_type") == "response")
    # Rows of one id may have been written twice; one of the equal payloads is enough.
    bodies = have.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("original_payload")).dropDuplicates(["refers_to", "payload_digest"])
    missing = records.where(F.col("record_type") == "revisit").join(bodies, ["refers_to", "payload_digest"], "left")
    whole = have.select("page_id", "uri", "payload").unionByName(missing.select("page_id", "uri", F.col("original_payload").alias("payload")))
    return write_archives(whole.select("page_id", F.col("uri").alias("url"), F.col("payload").cast("string").alias("html")), target, min_bytes)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
