"""WARC archives: written from pages, read back, and put together as one nested row per capture.

Writing. Of pages with equal payloads (SHA-1) the one with the smallest id becomes a ``response`` record, the others
become ``revisit`` records that refer to it and hold only the HTTP header; payloads below ``least_bytes`` are all
responses. Every capture gets a ``request`` and a ``metadata`` record too (with the page's id and exact url), tied to
the first record by WARC-Concurrent-To. A record ends with an empty line, so the archive is a text table with that line
separator, gzipped: the JVM writes it to any shared storage, and a lost task writes its file anew.

Payloads that few pages share meet in one window each. Those of very many pages (``tables.common_keys``, at most
10,000) are told apart beforehand by a count: their revisits never need the html, which only the original keeps, so
they are numbered where they are and learn their original from a broadcast.

Reading. The text source cuts the files where a record's end is followed by a version line, and one task streams
through each file, one record at a time: Content-Length tells whether a piece is a whole record or a payload that
holds the separator itself, which is then put together again.

Assembly. Request and metadata records are joined to their response or revisit through concurrent-to identifiers,
whichever side names the other, also from a metadata record to a request. A capture nests the first record of each
kind by id; more of a kind, and records that belong to no capture, come out as rows of their own (``response`` null),
so no record is lost. Records that very many others name are looked up by broadcast as above.

Null html is an empty payload; a null page id comes after all others, and stays null. A null url has no target.
Rows that repeat id and html are one response and its revisits. Very long payloads pass through one row's memory. Other
columns play no part. An empty table gives an archive without records and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oligoloom.llm.tables import common_keys, lookup, stored

VERSION = "WARC/1.1"
RECORDS_PER_FILE = 60_000
# Fixed values of the format.
_CRLF = "\r\n"
_RECORD_END = _CRLF + _CRLF
_EMPTY_LINE = _RECORD_END.encode()
# Where archives are cut: an empty line alone may well stand in a payload.
_SEPARATOR = (_RECORD_END + "WARC/1.").encode()
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_LAST_ID = (1 << 63) - 1


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits of the digest at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32_DIGITS)


def record_id(*names: Column) -> Column:
    """A URN that the names decide, in the form of a UUID with freely chosen bits (version 8)."""
    h = F.sha2(F.concat_ws("/", *names), 256)
    part = lambda first, size: F.substring(h, first, size)
    shape = [part(1, 8), part(9, 4), F.concat(F.lit("8"), part(13, 3)), F.concat(F.lit("a"), part(16, 3)), part(19, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *shape), F.lit(">"))


def _one_line(value: Column) -> Column:
    """Header values hold no blanks or line breaks; they are percent-encoded."""
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def _lines(*fields: tuple[str, Column]) -> Column:
    """``name: value`` lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(name + ": "), v, F.lit(_CRLF)), F.lit("")) for name, v in fields])


def _record(kind: str, record: Column, date: str, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    head = _lines(
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", record),
        ("WARC-Date", F.lit(date)),
        *more,
        ("Content-Type", F.lit(content_type)),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(VERSION + _CRLF), head, F.lit(_CRLF), block)


def _captures(pages: DataFrame, page: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, size, own, original): names of the page's first record and of its original."""
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("size", F.octet_length("html").cast("long"))
    large = rows.where(F.col("size") >= least_bytes).withColumn("digest", base32_sha1(F.col("html")))
    place = F.struct(F.coalesce("page_id", F.lit(_LAST_ID)).alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    number = F.monotonically_increasing_id().cast("string")
    none = F.lit(None).cast("string")
    columns = ["page_id", "url", "html", "digest", "size", "own", "original"]

    common = common_keys(large.select("digest"), "digest")
    few = large.join(F.broadcast(common), "digest", "left_anti")
    among = Window.partitionBy("digest").orderBy(place)
    few = few.withColumn("nth", F.row_number().over(among)).withColumn("own", F.format_string("few %d", "nth"))
    few = few.withColumn("original", F.when(F.col("nth") > 1, F.lit("few 1")))
    captures = few.select(columns)
    if least_bytes > 0:
        small = rows.where(F.col("size") < least_bytes).withColumn("digest", base32_sha1(F.col("html")))
        small = small.withColumn("own", F.concat(F.lit("small "), number)).withColumn("original", none)
        captures = captures.unionAll(small.select(columns))
    if common.isEmpty():
        return captures

    # Rows of common payloads are numbered without their html, in a stored table.
    shared = large.join(F.broadcast(common), "digest")
    many = stored(
        shared.select("page_id", "url", "digest", "size", F.concat(F.lit("many "), number).alias("own")), "common-pages"
    )
    first = many.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "own")).alias("first"))
    first = F.broadcast(first.select("digest", "first.place.id", F.col("first.own").alias("original")))
    many = many.join(first, "digest").drop("id")
    revisits = many.where(F.col("own") != F.col("original")).withColumn("html", F.lit(""))
    texts = shared.join(first, "digest").where(F.coalesce("page_id", F.lit(_LAST_ID)) == F.col("id"))
    texts = texts.select("digest", "html").dropDuplicates(["digest"])
    originals = many.where(F.col("own") == F.col("original")).join(texts, "digest").withColumn("original", none)
    return captures.unionAll(originals.select(columns)).unionAll(revisits.select(columns))


def write_archive(
    pages: DataFrame,
    path: str,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Three records for every page, in gzipped files below ``path``."""
    rows = _captures(pages, page, url, payload, least_bytes)
    rows = rows.select(
        "*",
        record_id(F.col("digest"), F.col("own")).alias("record"),
        record_id(F.col("digest"), F.col("original")).alias("refers_to"),
        _one_line(F.col("url")).alias("target"),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(_RECORD_END),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    target = ("WARC-Target-URI", F.col("target"))
    http_type = "application/http; msgtype="
    together = ("WARC-Concurrent-To", F.col("record"))
    response = _record(
        "response", F.col("record"), date, http_type + "response", F.concat(http, F.col("html")), target, digest
    )
    revisit = _record(
        "revisit", F.col("record"), date, http_type + "response", http, target, digest,
        ("WARC-Profile", F.lit(_REVISIT_PROFILE)), ("WARC-Refers-To", F.col("refers_to")),
    )
    asked = F.concat(F.lit("GET "), F.coalesce("target", F.lit("/")), F.lit(f" HTTP/1.1{_RECORD_END}"))
    request = _record(
        "request", record_id(F.col("record"), F.lit("request")), date, http_type + "request", asked, target, together
    )
    about = _lines(("page-id", F.col("page_id").cast("string")), ("url", F.col("target")))
    metadata = _record(
        "metadata", record_id(F.col("record"), F.lit("metadata")), date, "application/warc-fields", about, target,
        together,
    )
    first = F.when(F.col("original").isNull(), response).otherwise(revisit)
    records = rows.select(F.explode(F.array(request, first, metadata)).alias("value"))
    writer = records.write.option("lineSep", _RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = (
    "record_id string, type string, target string, date string, concurrent_to array<string>, refers_to string,"
    " payload_digest string, fields map<string, string>, payload binary, payload_bytes long"
)
_RECORD_ARROW = pa.schema(
    [
        *[(name, pa.string()) for name in ("record_id", "type", "target", "date")],
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
    ]
)
_FRESH = re.compile(rb"WARC/1\.[0-9]+\r\n")
# Payload bytes that a batch of records may hold before it is passed on.
_BATCH_BYTES = 4 << 20


def _header_lines(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode("utf-8", "replace").split(_CRLF)
    pairs = (line.partition(":") for line in lines if ":" in line)
    return [(name.strip().lower(), value.strip()) for name, _, value in pairs]


def _decoded(value: str) -> str:
    for coded, plain in (("%20", " "), ("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        value = value.replace(coded, plain)
    return value


def whole_records(pieces: Iterable[tuple[bytes, str]]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header, block) of every record in (piece, file) of archives cut at ``_SEPARATOR``.

    A piece that is shorter than its Content-Length was cut inside its block; the next pieces of its file belong to
    it. A record that ends with its file before its length is reached has the block that there is.
    """
    held: list[bytes] = []
    size = start = wanted = 0
    header: list[tuple[str, str]] = []
    place = None
    for piece, file in pieces:
        if held and file != place:
            yield header, b"".join(held)[start:]
            held = []
        place = file
        if held:
            held += [_SEPARATOR, piece]
            size += len(_SEPARATOR) + len(piece)
        else:
            if not _FRESH.match(piece):
                piece = b"WARC/1." + piece
            if not _FRESH.match(piece):
                continue
            head, _, block = piece.partition(_EMPTY_LINE)
            header, start = _header_lines(head), len(head) + len(_EMPTY_LINE)
            wanted = start + int(dict(header).get("content-length", 0))
            # A record without a block may have been cut at the end of its header.
            held, size = [piece], max(len(piece), start) if not block else len(piece)
        if size >= wanted:
            yield header, b"".join(held)[start:wanted]
            held = []
    if held:
        yield header, b"".join(held)[start:]


def _payload(kind: str, header: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes, int]:
    """Named fields, payload and its full length: behind the HTTP header, or what that header states for a revisit."""
    if header.get("content-type", "").startswith("application/warc-fields"):
        return dict(_header_lines(block)), b"", 0
    if not header.get("content-type", "").startswith("application/http"):
        return {}, block, len(block)
    head, _, body = block.partition(_RECORD_END.encode())
    fields = dict(_header_lines(head))
    return fields, body, int(fields.get("content-length", 0)) if kind == "revisit" else len(body)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) of all archives below ``path``; ``payload`` is null without ``payloads``.

    The payload's digest is taken from the payload itself; a revisit has the one that its header states.
    """

    def row(header: list[tuple[str, str]], block: bytes) -> tuple:
        named = dict(header)
        kind = named.get("warc-type")
        fields, body, size = _payload(kind, named, block)
        stated = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            stated = base64.b32encode(hashlib.sha1(body).digest()).decode()
        target = named.get("warc-target-uri")
        return (
            named.get("warc-record-id"), kind, None if target is None else _decoded(target), named.get("warc-date"),
            [v for n, v in header if n == "warc-concurrent-to"], named.get("warc-refers-to"), stated,
            list(fields.items()), body if payloads else None, size,
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RECORD_ARROW)]
        return pa.RecordBatch.from_arrays(columns, schema=_RECORD_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pieces = ((v.as_py(), f.as_py()) for batch in batches for v, f in zip(*batch.columns))
        for header, block in whole_records(pieces):
            rows.append(row(header, block))
            held += len(block)
            if held >= _BATCH_BYTES or len(rows) >= 1000:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    pieces = spark.read.option("lineSep", _SEPARATOR.decode()).text(path)
    return pieces.select(F.col("value").cast("binary"), F.col("_metadata.file_path")).mapInArrow(run, RECORD)


_ANCHORS = ("response", "revisit", "resource")
_FIELDS = [field.name for field in _RECORD_ARROW]


def _captures_of_parts(parts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(record_id, capture) of the records that an anchor names or that name one, themselves or through another."""
    known = anchors.select("record_id", F.col("record_id").alias("capture"))
    named = parts.select("record_id", F.explode("concurrent_to").alias("other"))
    by_anchor = anchors.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    direct = lookup(stored(named, "named"), known.withColumnRenamed("record_id", "other"), "other")
    found = direct.where("capture is not null").select("record_id", "capture").unionByName(by_anchor)
    found = stored(found.groupBy("record_id").agg(F.min("capture").alias("capture")), "tied-records")
    # Named only by way of another record, such as metadata about a request.
    open_ends = stored(named.join(found, "record_id", "left_anti"), "open-ends")
    if open_ends.isEmpty():
        return found
    through = lookup(open_ends, found.withColumnRenamed("record_id", "other"), "other").where("capture is not null")
    return found.unionByName(through.groupBy("record_id").agg(F.min("capture").alias("capture")))


def assemble(records: DataFrame) -> DataFrame:
    """(capture, response, request, metadata, other): one nested row per capture.

    A record that a capture has no place for is a row of its own: its ``capture`` and ``response`` are null.
    ``records`` should be a stored table.
    """
    whole = F.struct(*_FIELDS)
    is_anchor = F.coalesce(F.col("type").isin(*_ANCHORS), F.lit(False))
    anchors, parts = records.where(is_anchor), records.where(~is_anchor)
    tied = _captures_of_parts(parts, anchors)
    parts = stored(parts.join(tied, "record_id", "left"), "parts")

    def first(kind: str) -> Column:
        return F.min_by(whole, F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)

    nested = parts.where("capture is not null").groupBy("capture").agg(first("request"), first("metadata"))
    nested = stored(nested, "nested")
    captures = anchors.select(F.col("record_id").alias("capture"), whole.alias("response")).join(
        nested, "capture", "left"
    )
    placed = nested.select(F.explode(F.array("request.record_id", "metadata.record_id")).alias("record_id"))
    left = parts.join(placed.where("record_id is not null"), "record_id", "left_anti")
    kind = F.col("type")
    left = left.select(
        F.lit(None).cast("string").alias("capture"),
        F.lit(None).cast(captures.schema["response"].dataType).alias("response"),
        F.when(kind == "request", whole).alias("request"),
        F.when(kind == "metadata", whole).alias("metadata"),
        F.when(kind.isNull() | ~kind.isin("request", "metadata"), whole).alias("other"),
    )
    return captures.withColumn("other", F.lit(None).cast(left.schema["other"].dataType)).unionByName(left)


def page_records(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every capture of ``write_archive``."""
    rows = stored(
        captures.where("capture is not null").select(
            F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
            "response.payload_bytes",
            "response.payload_digest",
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("record"),
            F.col("response.target").alias("url"),
            "capture",
        ),
        "captures",
    )
    responses = rows.where("record is null").withColumn("refers_to", F.lit(None).cast("long"))
    pages = responses.select(F.col("capture").alias("record"), F.col("page_id").alias("refers_to"))
    revisits = lookup(rows.where("record is not null"), pages, "record")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return responses.select(columns).unionAll(revisits.select(columns))
