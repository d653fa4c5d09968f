"""WARC archives: writing page records in segments, and reassembling them.

The writer frames each payload in chunks under an HTTP header. A block over the
segment size continues in records of another archive, which name the record
that they began in. Payloads that occur again are written as revisits, which
name the response's record. Archives are gzip members, one a record, held as
rows of a table in the shared folder. The reader groups continuation records by
origin, orders them by number, checks the total length, decodes the chunks, and
looks up the response of every revisit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Largest block of one record, and bytes of one HTTP chunk.
SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
#: Payloads from this size on are written once.
DEDUPE_BYTES = 1000
#: Bytes of an archive before the next begins, and the date that records carry.
ARCHIVE_BYTES, DATE = 4 << 20, "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[line + 2 : line + 2 + size]
        at = line + 2 + size + 2
        if len(piece) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(piece)


def record(kind: str, name: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One record with its own headers."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def response_name(page_id: int, sha1: str) -> str:
    """Record id of the response that revisits of a payload refer to."""
    return f"urn:page:{page_id}:{sha1}"


def page_records(page_id: int | None, name: str, url: str, payload: bytes, sha1: str, origin: int | None, revisit: bool, segment: int) -> list[bytes]:
    """Records of a page under a record id: one, or several where its block is over the segment size."""
    shared = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    if revisit:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", name, block, [*shared, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{response_name(origin, sha1)}>"), ("Content-Type", "application/http;msgtype=response")])]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http;msgtype=response")
    if len(block) <= segment:
        return [record("response", name, block, [*shared, kind])]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record("response", name, pieces[0], [*shared, kind, ("WARC-Segment-Number", "1")])]
    for k, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if k == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", f"{name}:{k}", piece, [*shared, *more]))
    return out


def write_archives(segment: int):
    """Map over pages: archives as (name, content); continuations go to archives of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        open_: dict[str, list[bytes]] = {"main": [], "continued": []}
        sizes, numbers = {"main": 0, "continued": 0}, {"main": 0, "continued": 0}

        def flush(which: str) -> pa.RecordBatch:
            name = f"pages-{part:05d}-{which}-{numbers[which]:05d}.warc.gz"
            numbers[which] += 1
            content = b"".join(open_[which])
            open_[which], sizes[which] = [], 0
            return pa.RecordBatch.from_pydict({"name": pa.array([name]), "content": pa.array([content], pa.binary())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "origin", "revisit", "again"))
            for page_id, url, html, digest, origin, revisit, again in zip(*columns, strict=True):
                name = f"urn:page:{'' if page_id is None else page_id}:{(part << 32) + serial}"
                if origin is not None and not revisit and not again:
                    name = response_name(page_id, digest)
                records = page_records(page_id, name, url, html.encode(), digest, origin, revisit, segment)
                serial += 1
                for k, rec in enumerate(records):
                    which = "continued" if k else "main"
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(rec) + packer.flush()
                    open_[which].append(member)
                    sizes[which] += len(member)
                    if sizes[which] >= ARCHIVE_BYTES:
                        yield flush(which)
        for which in open_:
            if open_[which]:
                yield flush(which)

    return run


def members(content: bytes) -> Iterator[bytes]:
    """Records of an archive, one gzip member at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + (1 << 14)]
            if not len(piece):
                raise ValueError("archive cut short")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def finish(headers: dict[str, str], block: bytes) -> tuple[str, int | None, int | None, str, str, int | None, str | None]:
    """What a whole record says: its id, page, payload bytes and digest, type, page and record referred to."""
    http, _, body = block.partition(b"\r\n\r\n")
    told = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    name = headers["warc-record-id"].strip("<>")
    if headers["warc-type"] == "revisit":
        other = headers["warc-refers-to"].strip("<>")
        return name, _page(name), None, told, "revisit", _page(other), other
    payload = dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding: *chunked", http) else body
    sha1 = hashlib.sha1(payload).hexdigest()
    if sha1 != told:
        raise ValueError(f"payload of record {name} does not have its digest")
    return name, _page(name), len(payload), sha1, "response", None, None


_DONE = [("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("response_id", pa.string())]
_DONE_SQL = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, response_id string"
_PART = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())]


def read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over archives: whole records read, segments passed on with their origin."""
    kinds = pa.schema([*_DONE, *_PART])
    for batch in batches:
        for content in batch.column("content").to_pylist():
            out: list[dict] = []
            for rec in members(content):
                headers, block = parse(rec)
                number = headers.get("warc-segment-number")
                if number is None:
                    out.append(dict(zip((n for n, _ in _DONE), finish(headers, block), strict=True)))
                else:
                    out.append(
                        {
                            "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "number": int(number), "block": block,
                            "total": int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None, "digest": headers["warc-payload-digest"],
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, kinds)


def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over segments sorted by origin and number: their whole records."""
    kinds = pa.schema(_DONE)
    held: list[dict] = []

    def whole() -> dict:
        if [s["number"] for s in held] != list(range(1, len(held) + 1)):
            raise ValueError(f"segments of {held[0]['origin']} are missing or repeated")
        block = b"".join(s["block"] for s in held)
        if held[-1]["total"] != len(block):
            raise ValueError(f"segments of {held[0]['origin']} do not have their total length")
        headers = {"warc-type": "response", "warc-record-id": held[0]["origin"], "warc-payload-digest": held[0]["digest"]}
        return dict(zip((n for n, _ in _DONE), finish(headers, block), strict=True))

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and row["origin"] != held[0]["origin"]:
                out.append(whole())
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)
    if held:
        yield pa.RecordBatch.from_pylist([whole()], kinds)


def write_pages(pages: DataFrame, scratch: Scratch, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives: a table of name and content.

    Of equal payloads of DEDUPE_BYTES or more, rows with the largest page_id are
    responses and the others revisits of it. Where several rows have that page_id
    and payload, one of them, of the smallest url, has the id that revisits name.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    ids = rows.where(F.octet_length("html") >= DEDUPE_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    groups = ids.groupBy("digest").agg(F.max(F.struct("page_id", "copies")).alias("top"), F.sum("copies").alias("n"))
    groups = scratch.write(groups.where("n > 1 and top.page_id is not null").select("digest", F.col("top.page_id").alias("origin"), F.col("top.copies").alias("copies")), "groups")
    told = rows.join(groups, "digest", "left").withColumn("revisit", F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin")))
    # rows that share the largest page_id of their payload: one keeps the name that revisits use
    several = F.coalesce(F.col("copies") > 1, F.lit(False)) & ~F.col("revisit")
    told = told.select("page_id", "url", "html", "digest", "origin", "revisit", "copies", several.alias("several"))
    plain = told.where("not several").withColumn("again", F.lit(False))
    if groups.where("copies > 1").limit(1).count():
        same = told.where("several").groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"), F.first("html").alias("html"), F.first("origin").alias("origin"))
        least = told.where("several").groupBy(F.col("digest").alias("_digest")).agg(F.min("url").alias("_url"))
        same = same.join(least, F.col("digest") == F.col("_digest")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        again = ~((F.col("k") == 1) & (F.col("url") == F.col("_url")))
        plain = plain.drop("copies", "several").unionByName(same.select("page_id", "url", "html", "digest", "origin", F.lit(False).alias("revisit"), again.alias("again")))
    return scratch.write(plain.select("page_id", "url", "html", "digest", "origin", "revisit", "again").mapInArrow(write_archives(segment), "name string, content binary"), "archives")


def read_pages(archives: DataFrame) -> DataFrame:
    """Records of archives (content), one row a page: sizes, digests, types, references.

    A revisit has the size and digest of the response that it names; one whose
    response is missing or has another payload is an error, as are segments that
    are missing or repeated or do not have their total length.
    """
    spark = archives.sparkSession
    scratch = Scratch(spark, "warc-read")
    part = "origin string, number int, total long, digest string, block binary"
    seen = scratch.write(archives.select("content").mapInArrow(read_archives, f"{_DONE_SQL}, {part}"), "records")
    names = [n for n, _ in _DONE]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = seen.where("origin is not null").select("origin", "number", "total", "digest", "block").repartition(parts, "origin").sortWithinPartitions("origin", "number")
    whole = seen.where("origin is null").select(*names).unionByName(split.mapInArrow(reassemble, _DONE_SQL))
    whole = scratch.write(whole, "whole")
    responses = whole.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    wanted = responses.join(whole.where("record_type = 'revisit'").select(F.col("response_id").alias("_id")).distinct(), "_id", "left_semi")
    found = whole.join(wanted, F.col("response_id") == F.col("_id"), "left")
    broken = (F.col("record_type") == "revisit") & ~F.coalesce(F.col("_digest") == F.col("payload_digest"), F.lit(False))
    size = F.when(broken, F.raise_error(F.concat(F.lit("no response with the payload of record "), F.col("record_id")))).otherwise(F.coalesce("payload_bytes", "_bytes"))
    return found.select("page_id", size.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", "response_id")


def round_trip(pages: DataFrame, scratch: Scratch | None = None, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages as archives and read them back.

    Null html: an empty payload. Null url: empty. Null page_id: kept, null; a
    response unless an equal payload has an id. Repeated rows: each is a record;
    those with the largest id of their payload are all responses. Empty table:
    no rows. Other columns are ignored.
    """
    return read_pages(write_pages(pages, scratch or Scratch(pages.sparkSession, "warc"), segment))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages and read them back."""
    read = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
m as (select *, max(page_id) over (partition by html) as origin from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
  case when payload_bytes >= 1000 and origin is not null and page_id is distinct from origin then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and origin is not null and page_id is distinct from origin then origin end as refers_to
from m
"""
