"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

Writer: the payload is the page's HTML in UTF-8 behind an HTTP header. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest ``page_id`` is a response; the others are revisit records that name
it and carry the payload's digest and, in the HTTP header, its length. Each task writes one file under another name
and then moves it, so a task that runs again leaves one whole file.

Reader: files are cut into byte ranges. A task scans its range for gzip's magic bytes, takes a candidate for a member
if it inflates to a WARC header, and owns the members that start in its range, reading beyond its end for the last
one. A member may hold several records. Records of any type and of other writers are read: fields that a record lacks
are null, headers may be folded or Latin-1, bodies may be chunked. Lengths are checked, and digests of the algorithms
in ``_DIGESTS``.

Damage is never skipped in silence: a member that doesn't inflate to its end, a record of another length or payload
than its header says, and bytes between members that belong to none each give a row with ``error``, ``file`` and
``offset``. A record over ``max_record_bytes`` is such a row too, so that a task's memory has a bound.

Defined results: null HTML is an empty payload; pages of any length are written whole; rows of one payload that all
have its smallest id are all responses; null ids come last (a payload with null ids only has responses); a null url
is left out; line breaks in a url are percent-encoded; an empty table gives no record. A payload that itself holds
gzip members of WARC records, stored without compression, can't be told from members by a task that starts inside it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
_DATE = "2000-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as bytes, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str) -> int:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz`` files under ``path``; the number of records."""
    filesystem, folder = _filesystem(path)
    filesystem.create_dir(folder, recursive=True)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = keyed.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = keyed.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first_id").distinct()
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = full.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "first_id").sortWithinPartitions("page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        filesystem, folder = _filesystem(path)
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        own = f"{folder}/.writing-{context.taskAttemptId()}"
        with filesystem.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(gzip.compress(warc_record(*values), mtime=0))
                    n += 1
        if n:
            filesystem.move(own, name)
        else:
            filesystem.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Bytes given to the inflater at first; each further piece is twice as long, up to ``_PIECE``.
_FIRST, _PIECE = 1 << 10, 1 << 16


class _Members:
    """The gzip members of a file that start in a byte range, as (offset, data or None, error)."""

    def __init__(self, file, length: int, start: int, end: int, limit: int):
        self.file, self.length, self.start, self.end, self.limit = file, length, start, end, limit
        self.base, self.held = start, b""  # ``held`` are the file's bytes from ``base`` on

    def _upto(self, at: int, n: int) -> int:
        """Hold the ``n`` bytes from ``at`` on, where the file has them; the place of ``at`` in what is held."""
        if not self.base <= at <= self.base + len(self.held):
            self.base, self.held = at, b""
        while self.base + len(self.held) < min(at + n, self.length):
            self.base, self.held = at, self.held[at - self.base :]
            self.file.seek(at + len(self.held))
            self.held += self.file.read(max(_READ, n))
        return at - self.base

    def _find(self, at: int) -> int:
        """The next place of gzip's magic bytes, or the file's length."""
        while at < self.length:
            place = self._upto(at, len(MAGIC))
            found = self.held.find(MAGIC, place)
            if found >= 0:
                return self.base + found
            at = max(at + 1, self.base + len(self.held) - len(MAGIC) + 1)
        return self.length

    def _inflate(self, start: int) -> tuple[bytes | None, int, str | None] | None:
        """The member at ``start``, where it ends, and what is wrong with it; none if it isn't a record's."""
        z, parts, at, size, piece, known = zlib.decompressobj(wbits=31), [], start, 0, _FIRST, b""
        while not z.eof:
            if at >= self.length:
                return (None, at, "truncated") if known == b"WARC/1." else None
            place = self._upto(at, 1)
            with memoryview(self.held) as held, held[place : place + piece] as part:
                try:
                    parts.append(z.decompress(part))
                except zlib.error:
                    return (None, start + 1, "damaged") if known == b"WARC/1." else None
                at += len(part)
            piece, size = min(2 * piece, _PIECE), size + len(parts[-1])
            if len(known) < 7:
                known = b"".join(parts)[:7]
                if known != b"WARC/1."[: len(known)]:
                    return None
            if size > self.limit:
                return None, start + 1, "too long"
        return (b"".join(parts), at - len(z.unused_data), None) if known == b"WARC/1." else None

    def __iter__(self) -> Iterator[tuple[int, bytes | None, str | None]]:
        # What comes before the first member of a range is the business of the range before, but for the file's start.
        at, behind = self.start, 0 if self.start == 0 else None
        while at < self.length and (at < self.end or behind is not None):
            found = self._find(at)
            member = self._inflate(found) if found < self.length else None
            if member is None and found < self.length:
                at = found + 1
                continue
            if behind is not None and found > behind:
                yield behind, None, f"{found - behind} bytes that are no record"
            behind = None
            if member is None or found >= self.end:
                return
            data, at, error = member
            yield found, data, error
            # After a whole member anything but another one is reported; after a damaged one its own row says enough.
            behind = at if data is not None and at < self.length else None


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields of a header block, names in lower case; folded lines belong to the field before."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    text = text.replace("\r\n", "\n")
    first, *lines = (re.sub(r"\n[ \t]+", " ", text) if "\n " in text or "\n\t" in text else text).split("\n")
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """WARC header and block of the record at ``at``, and where it ends; ValueError if its length isn't as it says."""
    stop = data.find(b"\r\n\r\n", at)
    version, warc = _headers(data[at:stop] if stop >= 0 else b"")
    length = warc.get("content-length", "")
    if not version.startswith("WARC/1.") or not (length.isascii() and length.isdigit()):
        raise ValueError("no WARC header with a length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("another length than the header says")
    return warc, data[stop + 4 : end], end + 4


def _unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, none if it isn't one."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        size = body[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return None


_DIGESTS = ("sha1", "sha256", "md5")


def _digest_fits(written: str, payloads: list[bytes]) -> bool:
    """Whether a digest (``algorithm:value`` in hexadecimal digits or base 32) is one of ``payloads``', or of an
    algorithm that isn't known here."""
    kind, _, value = written.partition(":")
    if kind.lower() not in _DIGESTS:
        return True
    found = [hashlib.new(kind.lower(), p, usedforsecurity=False) for p in payloads]
    return any(value.lower() == d.hexdigest() or value.upper().rstrip("=") == base64.b32encode(d.digest()).decode().rstrip("=") for d in found)


def read_record(warc: dict[str, str], block: bytes) -> dict[str, Any]:
    """A record's fields. HTTP records' payloads are their bodies, other records' their blocks; a revisit has none,
    and its length is what its HTTP header says."""
    kind = warc.get("warc-type")
    digest, error = warc.get("warc-payload-digest"), None
    payload, length = block, len(block)
    if warc.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(head)[1]
        said = http.get("content-length", "")
        number = said.lstrip("0") if said.isascii() and said.isdigit() else ""
        length = int(number or "0") if said.isascii() and said.isdigit() and len(number) <= 18 else len(payload)
        options = [payload]
        if "chunked" in http.get("transfer-encoding", "").lower() and (whole := _unchunked(payload)) is not None:
            payload, length = whole, len(whole)
            options.append(whole)
        if len(number) > 18:
            error = "a payload length in its header that no payload has"
        elif kind == "response" and length != len(payload):
            error = "another payload length than its header says"
    else:
        options = [payload]
    if kind == "revisit":
        payload = None
    elif error is None and digest is not None and not _digest_fits(digest, options):
        error = "another payload than its digest says"
    value = digest.partition(":")[2] if digest and digest.lower().startswith("sha256:") else digest
    return {"record_id": warc.get("warc-record-id"), "record_type": kind, "target_uri": warc.get("warc-target-uri"), "refers_to": warc.get("warc-refers-to"), "payload_bytes": length, "payload_digest": value, "payload": payload, "error": error}


RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string, file string, offset long"
_ARROW = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string(), "file": pa.string(), "offset": pa.int64()}


def records_in(file, name: str, length: int, start: int, end: int, limit: int) -> Iterator[dict[str, Any]]:
    """The records, and the damage, that a byte range of a file owns."""
    for offset, data, error in _Members(file, length, start, end, limit):
        at = 0
        if data is None:
            yield {"error": error, "file": name, "offset": offset}
        while data is not None and at < len(data):
            try:
                warc, block, at = parse_record(data, at)
            except ValueError as e:
                yield {"error": str(e), "file": name, "offset": offset}
                break
            yield read_record(warc, block) | {"file": name, "offset": offset}


def read_warc(spark: SparkSession, path: str, range_bytes: int = 8 << 20, with_payload: bool = True, max_record_bytes: int = 1 << 29) -> DataFrame:
    """All records of the ``*.warc.gz`` files under ``path``, and rows with ``error`` for what can't be read. Without
    ``with_payload`` payloads are checked and left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length").filter("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in _ARROW}
        held = 0

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in _ARROW.items()], names=list(_ARROW))
            for c in columns.values():
                c.clear()
            return out

        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                filesystem, inner = _filesystem(name)
                with filesystem.open_input_file(inner) as file:
                    for record in records_in(file, name, length, start, min(length, start + range_bytes), max_record_bytes):
                        if not with_payload:
                            record["payload"] = None
                        for c, values in columns.items():
                            values.append(record.get(c))
                        held += len(record.get("payload") or b"")
                        if held > 1 << 24 or len(columns["file"]) >= 10_000:
                            yield batch_of()
                            held = 0
        if columns["file"]:
            yield batch_of()

    return starts.repartition(n, "path", "start").mapInArrow(run, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """Records of pages as ``page_id, payload_bytes, payload_digest, record_type, refers_to``; fails on damage."""
    told = F.concat_ws(" ", F.lit("damaged archive:"), "file", F.col("offset").cast("string"), "error")
    records = records.withColumn("record_type", F.when(F.col("error").isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("record_type")))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
