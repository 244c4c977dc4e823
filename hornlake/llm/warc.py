"""WARC archives of web pages: written as transactions, read back and assembled to one nested row per capture.

Each page makes three records: a response, or a revisit of an equal payload's response, and a request and a metadata
record that name it in WARC-Concurrent-To.  Records are built by Spark's own functions and written by its text
writer, whose line separator is the end of a record, as gzip files of about `file_bytes` on average.  Archives are read
back by Spark's text reader, cut at the same separator: a task streams a file and joins the pieces again by
Content-Length, so its memory follows the largest record and not the file.  Assembly joins requests and metadata
to responses and revisits through the concurrent-to identifiers into one nested row per capture, payload included; a
principal record keeps the first of several by identifier and counts them, and a request or metadata record whose
principal is missing makes a row without one.

Of pages with equal payloads of `revisit_bytes` or more the one with the largest page id (of equal ids, the last
read) is the response.  Only the groups with more than one page are joined back, and by a table written before, so a
payload that a third of all pages have is split over tasks.

Defined results: null html is an empty payload, null url an empty target; a page without id gives a row with null
id (page ids are of an integer type; another one is refused); line breaks inside a url are dropped.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.shared import prepare, settled

CRLF = "\r\n"
END = b"\r\n\r\n"


def _urn(kind: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.col("uid").cast("string"), F.col("page_id").cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, identifier: Column, block: Column, content_type: str, date: str, *more: tuple[str, Column]) -> Column:
    lines: list[Column] = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: "), identifier]
    for name, value in more:
        lines += [F.lit(f"{CRLF}{name}: "), value]
    length = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF), block)


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """One gzip archive after another under `path`, of `file_bytes` before compression on average."""
    if not isinstance(pages.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    prepare(pages.sparkSession)
    base = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("uid"),  # by file split and place: the same whenever these files are read
    )
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    mean = 2000 + (base.agg(F.avg("bytes")).first()[0] or 0)
    records_per_file = max(1, int(3 * file_bytes / mean))
    groups = base.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "uid")).alias("top"), F.count("*").alias("n"))
    groups = settled(groups.filter("n > 1").select(F.col("digest").alias("digest_"), F.col("bytes").alias("bytes_"), "top"), "payloads")
    rows = base.join(groups, (F.col("digest") == F.col("digest_")) & (F.col("bytes") == F.col("bytes_")), "left")
    revisit = F.col("top").isNotNull() & (F.col("top.uid") != F.col("uid"))
    principal = _urn("capture")
    top = F.col("top")
    refers = F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *(F.substring(F.md5(F.concat_ws(":", F.lit("capture"), top["uid"].cast("string"), top["page_id"].cast("string")).cast("binary")), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        F.lit(">"),
    )
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    to = ("WARC-Concurrent-To", principal)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    response = _record("response", principal, F.concat(http, F.col("html")), "application/http;msgtype=response", date, target, digest)
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    again = _record("revisit", principal, http, "application/http;msgtype=response", date, target, digest, profile, ("WARC-Refers-To", refers))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Accept: */*{CRLF}{CRLF}"))
    request = _record("request", _urn("request"), get, "application/http;msgtype=request", date, target, to)
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"via: pages{CRLF}"))
    metadata = _record("metadata", _urn("metadata"), fields, "application/warc-fields", date, target, to)
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, by lower-case name, and the block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length") or 0)
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield headers, block


class Pieces(io.RawIOBase):
    """A stream of the pieces that a reader cut at record ends, with those put back."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece + END)
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


_FIELDS = "id string, type string, concurrent_to string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _rows(keep_payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [f.split()[0] for f in _FIELDS.split(", ")]

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

        pieces = (piece.as_py() for batch in batches for piece in batch.column(0))
        found, size = [], 0
        for h, block in parse(io.BufferedReader(Pieces(pieces), 1 << 20)):
            kind = h.get("warc-type", "")
            body = block.partition(END)[2] if h.get("content-type", "").startswith("application/http") else block
            fields = [tuple(p.strip() for p in line.split(":", 1)) for line in block.decode("utf-8", "replace").split(CRLF) if ":" in line] if h.get("content-type") == "application/warc-fields" else None
            own = kind in ("response", "resource")
            digest = hashlib.sha1(body).hexdigest() if own else h.get("warc-payload-digest", "").rpartition(":")[2] or None
            found.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), digest, len(body) if own else None, fields, body if keep_payload and own else None))
            size += len(block)
            if len(found) >= 2000 or keep_payload and size > 1 << 23:
                yield made(found)
                found, size = [], 0
        yield made(found)

    return rows


def read_records(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """A row for each record of the gzip archives under `path`.

    A gzip file is one task's, read as a stream.  Files that Spark would split, such as plain ones, are refused.
    """
    prepare(spark)
    pieces = spark.read.option("lineSep", CRLF + CRLF).text(path)
    if any(not f.endswith(".gz") for f in pieces.inputFiles()):
        raise ValueError("archives must be gzip files, which are read from their beginning")
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_rows(payload), _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: id, response, request, metadata (structs) and the numbers of requests and metadata records."""
    whole = F.struct(*records.columns)
    main = records.filter(F.col("type").isin("response", "revisit", "resource")).select("id", whole.alias("response"))
    sides = [
        records.filter(F.col("type") == kind).groupBy(F.coalesce("concurrent_to", "id").alias("id")).agg(F.min_by(whole, "id").alias(kind), F.count("*").alias(f"n_{kind}"))
        for kind in ("request", "metadata")
    ]
    # The narrow sides come together first, so that payloads are shuffled once.
    out = main.join(sides[0].join(sides[1], "id", "full_outer"), "id", "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_request", "n_metadata")})


def page_captures(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures whose metadata name the page."""
    flat = captures.filter("response is not null").select(
        F.col("id"),
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.coalesce(F.octet_length("response.payload").cast("long"), F.col("response.payload_bytes")).alias("bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.refers_to").alias("to"),
    )
    flat = settled(flat, "captures")
    there = flat.filter("record_type = 'response'").select(F.col("id").alias("there"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("there_bytes"))
    revisits = flat.filter("record_type <> 'response'").join(there, F.col("to") == F.col("there"), "left")
    named = revisits.select("page_id", F.coalesce("bytes", "there_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = flat.filter("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(named)
