"""Operator 7. WARC archives: write pages as records, read archives back with segment reassembly.

Writing: records are UTF-8 and written by Spark's text writer with the blank lines that end a record as its separator, gzipped by file, so archives land wherever Spark writes. A record's block has at most SEGMENT_BYTES and a file
RECORDS_A_FILE records, which bounds files by bytes too (66 MB before compression). Payloads travel as HTTP responses in chunked transfer framing; a longer block is written as a record and continuations (WARC-Segment-Number, -Origin-ID,
and -Total-Length on the last). Of pages with equal payloads the one with the largest page_id is a response, the others revisit it; a hot payload is counted with map-side aggregation, and
the join on its digest is split by adaptive execution. Page numbers stand in fields of their own (Page-ID, Refers-To-Page-ID). A response's id is made of its page and digest, so that nothing depends on where a retried task puts a row.

Reading (`read_records`) takes archives of others too: plain or gzipped by file or record, inflated piece by piece; all record types; segments that lie in any files. It walks each file by Content-Length, groups segments by origin, orders them by number, verifies
that none is missing and that their lengths add up to the total, decodes the framing, and verifies digests (SHA-1, SHA-2 or MD5 in base 32 or 16, over the payload or the body as it was sent) where a record has one. Whole records are decoded where they are
read; only segments are shuffled. For that each archive is read twice, which costs less than to shuffle all payloads once. A file itself is held whole, compressed, by its task.

A null html is an empty payload; a null url leaves out the target. Rows repeated under one page_id with one payload are responses all, if it is the largest, with ids of their own. A null page_id is smaller than any
other. Other columns are ignored. A broken archive (short block, missing segment, wrong digest or framing) raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import scratch_dir

#: Largest block of a record, and of an HTTP chunk, in bytes.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Least payload that a revisit stands for; smaller ones are all responses.
REVISIT_BYTES = 0
RECORDS_A_FILE = 4_000
#: Bytes that are inflated at once.
PIECE = 1 << 20
#: Fixed texts of the format.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """data in pieces of at most `size` bytes that begin no character inside."""
    start = 0
    while start < len(data):
        stop = min(start + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[start:stop]
        start = stop


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces(payload, CHUNK_BYTES)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("an HTTP chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n{block.decode('utf-8', 'replace')}"


def records(name: str | None, page: int | None, url: str | None, payload: bytes, first: int | None, first_name: str | None, revisit: bool) -> Iterator[str]:
    """The records of one page, without the blank lines after each. A page without a name gets one; a revisit names the page that it stands for, and its record if that is the only one."""
    own = name or f"urn:uuid:{uuid.uuid4()}"
    uri = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    common = [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Page-ID", page)]
    kind = ("Content-Type", "application/http; msgtype=response")
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{first_name}>" if first_name else None), ("Refers-To-Page-ID", first), kind], block)
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = list(pieces(block, SEGMENT_BYTES))
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), kind], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = len(block) if i == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256).to_pylist()
            values = [r for x in rows for r in records(x["name"], x["page"], x["url"], (x["html"] or "").encode(), x["first"], x["first_name"], x["revisit"])]
            yield pa.record_batch([pa.array(values, pa.string())], ["value"])


#: Stands for a null page_id.
_NO_PAGE = -(1 << 63)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write all pages as WARC files below path."""
    number = F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_PAGE).cast("long"))
    slim = pages.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), number.alias("number"))
    slim = slim.withColumn("digest", F.concat(F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("string")))
    held = slim.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest", "number").agg(F.count("*").alias("rows"))
    chosen = held.groupBy("digest").agg(F.max(F.struct("number", "rows")).alias("top")).select("digest", F.col("top.number").alias("first"), F.col("top.rows").alias("rows"))
    joined = slim.join(chosen, "digest", "left")

    def name(page: Column) -> Column:
        """An id made of the page and the digest, for a response that is alone in both."""
        h = F.md5(F.concat_ws("/", page.cast("string"), F.col("digest")).cast("binary"))
        parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
        return F.when(F.col("rows") == 1, F.concat(F.lit("urn:uuid:"), parts))

    page = lambda n: F.nullif(n, F.lit(_NO_PAGE))
    revisit = F.coalesce(F.col("number") < F.col("first"), F.lit(False))
    ready = joined.select(F.when(~revisit, name(F.col("number"))).alias("name"), page(F.col("number")).alias("page"), "url", "html", F.when(revisit, page(F.col("first"))).alias("first"), F.when(revisit, name(F.col("first"))).alias("first_name"), revisit.alias("revisit"))
    ready.mapInArrow(_written, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, piece by piece; gzip members follow one another."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + PIECE] for i in range(0, len(data), PIECE))
        return
    member, at = zlib.decompressobj(31), 0
    while at < len(data):
        fed = data[at : at + PIECE]
        out = member.decompress(fed, PIECE)
        at += len(fed) - len(member.unused_data)
        yield out
        while member.unconsumed_tail:
            yield member.decompress(member.unconsumed_tail, PIECE)
            at -= len(member.unused_data)
        if member.eof:
            if data[at : at + 2] not in (b"\x1f\x8b", b""):
                raise ValueError(f"no gzip member at byte {at}")
            member = zlib.decompressobj(31)
        elif at >= len(data):
            raise ValueError("a gzip member is cut short")


class _Pieces:
    """Reads a stream of pieces by length or up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held += piece
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(len(self.held) - len(mark), 0)
            if not self.more():
                return None
        return self.take(found + len(mark))[: -len(mark)]

    def skip(self, members: bytes) -> None:
        """Leave out bytes of these kinds."""
        while True:
            left = self.held.lstrip(members)
            del self.held[: len(self.held) - len(left)]
            if self.held or not self.more():
                return


def parsed(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Header, its fields (lower-case names) and block of each record of an archive."""
    stream, n = _Pieces(_inflated(data)), 0
    while True:
        stream.skip(b"\r\n")
        if not stream.held:
            return
        head = stream.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no header of a record after {n} records")
        text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.split("\r\n")[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"record {n} has no length")
        block = stream.take(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"record {n} is cut short")
        yield text, fields, block
        n += 1


_SEGMENT = "origin string, segment long, total long, header string, block binary"
_SEGMENT_SCHEMA = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("header", pa.string()), ("block", pa.binary())])


def _bare(name: str | None) -> str | None:
    return name.strip("<>") if name is not None else None


def _segments(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    """The records that are segments, or those that are not. The first segment of a record has its header, the others none."""
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SEGMENT_SCHEMA.types)], schema=_SEGMENT_SCHEMA)
    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for header, f, block in parsed(content.as_py()):
                number, total, part = f.get("warc-segment-number"), f.get("warc-segment-total-length"), f.get("warc-type") == "continuation"
                if segmented != (number is not None or part):
                    continue
                held.append((_bare(f.get("warc-segment-origin-id", f.get("warc-record-id"))), int(number) if number else None, int(total) if total else None, None if part else header, block))
                size += len(block)
                if size > 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)


def payload_of(segments: list[dict]) -> bytes:
    """The block of a record from its segments: (segment, total, block), in any order."""
    segments = sorted(segments, key=lambda s: s["segment"] or 0)
    block = b"".join(s["block"] for s in segments)
    if len(segments) > 1 or segments[0]["segment"] is not None:
        if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
            raise ValueError("segments are missing or their total length is wrong")
    return block


def matches(claimed: str, data: bytes) -> bool:
    """A digest as a record states it (algorithm:value, in base 32 or 16) is that of the data; one of an unknown algorithm passes."""
    algorithm, _, value = claimed.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(algorithm, data).digest()
    return value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=") or value.lower() == own.hex()


def decoded(name: str | None, fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None]:
    """The payload of a record and its number of bytes; a revisit has none, and its HTTP header may tell the number."""
    claimed = fields.get("warc-payload-digest")
    head, body = b"", block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get("warc-type") == "revisit":
        length = http.get(b"content-length", b"")
        return None, int(length) if length.isdigit() else None
    payload = body
    if b"chunked" in http.get(b"transfer-encoding", b"").lower():
        try:
            payload = dechunked(body)
        except ValueError:
            if claimed is None or not matches(claimed, body):  # some crawlers store the body without its framing
                raise
    if claimed is not None and not any(matches(claimed, x) for x in (payload, body)):
        raise ValueError(f"the payload of {name} does not match its digest")
    return payload, len(payload)


_RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, page_id long, refers_to_page_id long, header string"
_RECORD_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x is not None else None
    for batch in batches:
        out: list[tuple] = []
        for name, header, segments in zip(*(batch.column(c).to_pylist() for c in ("origin", "header", "segments"))):
            if header is None:
                raise ValueError(f"{name} has continuations but no first segment")
            f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.split("\r\n")[1:])}
            block = payload_of(segments)
            if len(segments) == 1 and "warc-block-digest" in f and not matches(f["warc-block-digest"], block):
                raise ValueError(f"the block of {name} does not match its digest")
            payload, size = decoded(name, f, block)
            claimed = f.get("warc-payload-digest") or (f"sha1:{digest32(payload)}" if payload is not None else None)
            out.append((name, f.get("warc-type"), _bare(f.get("warc-target-uri")), _bare(f.get("warc-refers-to")), claimed, size, payload, number(f.get("page-id")), number(f.get("refers-to-page-id")), header))
        columns = list(zip(*out)) if out else [()] * len(_RECORD_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD_TYPES)], [x.split()[0] for x in _RECORD.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path, of any type and origin, with its payload (null for revisits) and its header as it stands."""
    files = spark.read.format("binaryFile").load(path).select("content")
    part = F.struct("segment", "total", "block")
    whole = files.mapInArrow(lambda b: _segments(b, False), _SEGMENT).select("origin", "header", F.array(part).alias("segments"))
    split = files.mapInArrow(lambda b: _segments(b, True), _SEGMENT).groupBy("origin").agg(F.max("header").alias("header"), F.collect_list(part).alias("segments"))
    return whole.mapInArrow(_read, _RECORD).union(split.mapInArrow(_read, _RECORD))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) of each page that write_archives wrote; html is null for revisits."""
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    return read_records(spark, path).select("page_id", F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to_page_id").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch_dir(pages.sparkSession, "op7-archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
