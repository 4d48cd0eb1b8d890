"""Archives of other writers, damaged and padded ones, against records read one after the other."""

import base64
import gzip
import hashlib
import io
import random
import time

import pytest
from pyspark.errors import PySparkException

from flowseries.llm import warc


def member(kind, block, *lines, **options):
    head = [f"WARC/1.{options.get('minor', 0)}", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode(options.get("charset", "utf-8")) + b"\r\n\r\n" + block + b"\r\n\r\n"


def small(i):
    body = f"<p>page {i} {'x' * (i % 40)}</p>".encode()
    return warc.warc_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None)


def parts(tmp_path, spark, data, **options):
    (tmp_path / "a.warc.gz").write_bytes(data)
    return warc.read_warc(spark, f"file://{tmp_path}", **options).collect()


def test_foreign_records(spark, tmp_path):
    body = b"<p>chunked</p>"
    chunked = b"HTTP/1.1 200 OK\r\nX-Long: a\r\n b\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\n<p>ch\r\n9\r\nunked</p>\r\n0\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    records = [
        member("warcinfo", b"software: some\r\n", "Content-Type: application/warc-fields", "WARC-Filename: é", charset="latin-1"),
        member("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        member("response", chunked, "WARC-Record-ID: <urn:1>", http, f"WARC-Payload-Digest: sha1:{sha1}"),
        member("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, http, "WARC-Target-URI: http://h/\r\n  folded", f"WARC-Payload-Digest: sha1:{sha1}"),
        member("metadata", b"", "WARC-Payload-Digest: blake9:x"),
        member("response", b"HTTP/1.1 200 OK\r\n\r\nother", http, f"WARC-Payload-Digest: sha1:{sha1}"),
    ]
    for range_bytes in (1 << 23, 61):
        rows = parts(tmp_path, spark, b"".join(gzip.compress(r) for r in records), range_bytes=range_bytes)
        rows.sort(key=lambda r: r.offset)
        assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "metadata", "response"]
        assert [bytes(r.payload) for r in rows][2:5] == [body, body, b""] and [r.payload_bytes for r in rows] == [16, 0, 14, 14, 0, 5]
        assert rows[3].target_uri == "http://h/ folded" and [r.error for r in rows] == [None] * 5 + ["another payload than its digest says"]
    several = parts(tmp_path, spark, gzip.compress(b"".join(records[:5])))
    assert len(several) == 5 and {r.offset for r in several} == {0}


def test_padding_and_stray_bytes(spark, tmp_path):
    a, b = gzip.compress(small(1)), gzip.compress(small(2))
    cases = [(a + b"\0" * 512, 1, [len(a)]), (a + b"xyz!" + b, 2, [len(a)]), (b"junk" + a, 1, [0]), (a[:-9], 0, [0]), (a + b"\x1f\x8b\x08" + b, 2, [len(a)]), (b"\0" * 3000, 0, [0])]
    for data, good, errors in cases:
        for range_bytes in (1 << 23, 37):
            rows = parts(tmp_path, spark, data, range_bytes=range_bytes)
            assert sum(r.error is None for r in rows) == good and sorted(r.offset for r in rows if r.error) == errors
    with pytest.raises(PySparkException):
        warc.page_records(warc.read_warc(spark, f"file://{tmp_path}")).collect()


def test_flipped_bytes_are_reported(spark, tmp_path):
    r = random.Random(3)
    whole = [gzip.compress(small(i)) for i in range(200)]
    bad = {20, 21, 150}
    out = [m[:60] + bytes([m[60] ^ 255]) + m[61:] if i in bad else m for i, m in enumerate(whole)]
    for range_bytes in (1 << 23, r.randrange(200, 900)):
        rows = parts(tmp_path, spark, b"".join(out), range_bytes=range_bytes)
        assert {x.record_id for x in rows if x.error is None} == {f"<urn:page:{i}>" for i in range(200) if i not in bad}
        assert len([x for x in rows if x.error]) >= 2 and len(rows) == len({(x.offset, x.error) for x in rows})
    long = parts(tmp_path, spark, whole[0] + gzip.compress(small(1) + b" " * 100_000) + whole[2], max_record_bytes=50_000)
    assert sorted(str(x.error) for x in long) == ["None", "None", "too long"]


def test_every_byte_range_gives_each_record_once():
    r = random.Random(9)
    data = b"".join(gzip.compress(small(i)) for i in range(60)) + b"pad" + b"".join(gzip.compress(small(i)) for i in range(60, 70)) + b"\0" * 99
    want = [(x["offset"], x.get("record_id")) for x in warc.records_in(io.BytesIO(data), "f", len(data), 0, len(data), 1 << 20)]
    assert len(want) == 72
    for _ in range(40):
        cuts = sorted({0, len(data), *(r.randrange(len(data)) for _ in range(r.randrange(30)))})
        got = [(x["offset"], x.get("record_id")) for a, b in zip(cuts, cuts[1:], strict=False) for x in warc.records_in(io.BytesIO(data), "f", len(data), a, b, 1 << 20)]
        assert got == want


def test_reading_goes_back_behind_a_damaged_record(monkeypatch):
    """A long damaged record is read in pieces that are gone when the search for the next one starts behind its head."""
    monkeypatch.setattr(warc, "_READ", 64)
    noise = random.Random(1).randbytes(5000)
    bad = bytearray(gzip.compress(warc.warc_record(1, None, noise, hashlib.sha256(noise).hexdigest(), None)))
    bad[-5] ^= 255
    data = bytes(bad) + gzip.compress(small(2))
    got = list(warc.records_in(io.BytesIO(data), "f", len(data), 0, len(data), 1 << 20))
    assert [(x["offset"], x["error"]) for x in got] == [(0, "damaged"), (len(bad), None)]


def test_small_records_are_read_fast():
    """No copies of what is held for each record: time is in proportion to the records."""
    data = b"".join(gzip.compress(small(i), 1) for i in range(4000))
    began = time.process_time()
    n = sum(1 for _ in warc.records_in(io.BytesIO(data), "f", len(data), 0, len(data), 1 << 20))
    assert n == 4000 and time.process_time() - began < 2
