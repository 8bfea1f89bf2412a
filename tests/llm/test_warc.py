"""Archives that others wrote: record types, gzip members, digests, binary payloads, segments across files."""

import base64
import gzip
import hashlib

import pytest

from tracewell.llm import warc


def record(kind, name, block, *fields):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", warc.DATE), *fields, ("Content-Length", len(block))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def http(body, *fields):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body


HTTP = ("Content-Type", "application/http; msgtype=response")
RAW = bytes(range(256)) * 30


def base32(data, algorithm="sha1"):
    return base64.b32encode(hashlib.new(algorithm, data).digest()).decode()


@pytest.fixture(scope="module")
def foreign(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    framed = warc.chunked(b"plain text " * 900)
    first, second = record("warcinfo", "i", b"software: other\r\n", ("Content-Type", "application/warc-fields")), record("request", "q", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", ("Content-Type", "application/http; msgtype=request"))
    rest = [
        record("response", "binary", http(RAW), HTTP, ("WARC-Target-URI", "http://x/"), ("WARC-Payload-Digest", f"sha1:{base32(RAW)}")),
        record("response", "framed", http(framed, b"Transfer-Encoding: chunked"), HTTP, ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(framed).hexdigest()}")),
        record("response", "unframed", http(b"no chunks", b"Transfer-Encoding: chunked"), HTTP, ("WARC-Payload-Digest", f"md5:{base32(b'no chunks', 'md5')}")),
        record("response", "undigested", http(b""), HTTP, ("WARC-Target-URI", "<http://y/\r\n z>")),
        record("metadata", "m", b"a: b\r\n", ("Content-Type", "application/warc-fields")),
        record("resource", "r", b"\xff\xfe", ("Content-Type", "image/x"), ("WARC-Block-Digest", f"sha1:{base32(bytes([255, 254]))}")),
        record("revisit", "v", http(b"", b"Content-Length: 7680"), HTTP, ("WARC-Refers-To", "<urn:uuid:binary>")),
    ]
    whole = http(b"s" * 5000)
    parts = [record("response", "long", whole[:2000], HTTP, ("WARC-Segment-Number", 1)), record("continuation", "long2", whole[2000:4000], ("WARC-Segment-Origin-ID", "<urn:uuid:long>"), ("WARC-Segment-Number", 2))]
    parts.append(record("continuation", "long3", whole[4000:], ("WARC-Segment-Origin-ID", "<urn:uuid:long>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", len(whole))))
    (folder / "a.warc").write_bytes(first + second + parts[2])
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [*rest, parts[1]])))
    (folder / "c.warc.gz").write_bytes(gzip.compress(parts[0] * 1))
    return {r.record_id.rpartition(":")[2]: r for r in warc.read_records(spark, f"file://{folder}").collect()}


def test_all_records_are_read(foreign):
    assert {n: r.record_type for n, r in foreign.items()} == {"i": "warcinfo", "q": "request", "binary": "response", "framed": "response", "unframed": "response", "undigested": "response", "m": "metadata", "r": "resource", "v": "revisit", "long": "response"}


def test_payloads(foreign):
    payload = {n: r.payload for n, r in foreign.items()}
    assert bytes(payload["binary"]) == RAW and bytes(payload["framed"]) == b"plain text " * 900 and bytes(payload["unframed"]) == b"no chunks"
    assert bytes(payload["undigested"]) == b"" and bytes(payload["r"]) == b"\xff\xfe" and bytes(payload["long"]) == b"s" * 5000 and payload["v"] is None
    assert foreign["v"].payload_bytes == 7680 and foreign["v"].refers_to == "urn:uuid:binary"
    assert foreign["undigested"].payload_digest == f"sha1:{base32(b'')}" and foreign["undigested"].target_uri == "http://y/ z"


@pytest.mark.parametrize(
    "data",
    [
        record("response", "x", http(b"abc"), HTTP, ("WARC-Payload-Digest", f"sha1:{base32(b'abd')}")),
        record("resource", "x", b"abc", ("WARC-Block-Digest", f"sha1:{base32(b'abd')}")),
        record("response", "x", http(b"5\r\nab", b"Transfer-Encoding: chunked"), HTTP),
        record("response", "x", http(b"abc"), HTTP, ("WARC-Segment-Number", 1)) + record("continuation", "y", b"d", ("WARC-Segment-Origin-ID", "<urn:uuid:x>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", 30)),
        record("continuation", "y", b"d", ("WARC-Segment-Origin-ID", "<urn:uuid:x>"), ("WARC-Segment-Number", 2)),
        record("resource", "x", b"abc")[:-6],
        gzip.compress(record("resource", "x", b"abc" * 999))[:-20],
        b"something else\r\n\r\n",
    ],
    ids=["digest", "block digest", "framing", "missing segment", "no first segment", "cut short", "gzip cut short", "no archive"],
)
def test_broken_archives_are_refused(spark, tmp_path, data):
    (tmp_path / "x.warc").write_bytes(data)
    with pytest.raises(Exception, match="ValueError"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_ids_are_standard_and_resolve(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "same" if i % 3 else f"page {i} " * (4000 if i == 6 else 1)) for i in range(30)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}/w")
    rows = warc.read_records(spark, f"file://{tmp_path}/w").collect()
    ids = {r.record_id: r for r in rows}
    assert len(ids) == 30 and all(n.startswith("urn:uuid:") for n in ids)
    assert all(ids[r.refers_to].page_id == 29 == r.refers_to_page_id for r in rows if r.record_type == "revisit")
