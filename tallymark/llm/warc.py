"""WARC archives: written with one gzip member per record, read back one record after the other.

``write_archives`` writes a record per row, ``read_archives`` reads archives of any origin, ``resolved`` ties
revisit records to the responses they repeat. Archives lie in a folder that all executors reach (by any
scheme that ``pyarrow.fs`` opens); what counts is the staged list of archives, so files of lost or
repeated task attempts are never read.

Defined results. Null or empty payload: a record with an empty payload. Null url: no target URI. Null id: no id
in the record, and no other record refers to it. Control characters and spaces in a url are percent-encoded.
Repeated rows: a record each; rows that share id and payload share the record id, and all rows that hold the largest
id of equal payloads are responses. Empty table: no archive. Further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.llm.common import chunks, stage
from tallymark.operators.joins import looked_up
from tallymark.session import staging_root

ARCHIVE_BYTES = 256_000_000  # an archive is closed beyond this many compressed bytes; one task reads it
REVISIT_BYTES = 1000         # payloads from this size on are written once
BLOCK = 1 << 18              # bytes read, and at most unpacked, at a time
KEPT_BYTES = 8_000_000       # payload bytes handed on in one Arrow batch
CRAWLED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC format

MANIFEST = "archive string, records long, bytes long"
RECORD = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("id", pa.string()),
    ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("error", pa.string())])
RECORDS = ("archive string, start long, type string, record_id string, id string, url string, refers_to string, "
           "payload_bytes long, payload_digest string, payload binary, error string")


def write_archives(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", date: str = CRAWLED,
    archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None,
) -> DataFrame:
    """Write a record per row; returns the staged list ``(archive, records, bytes)``.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more the one with the largest id is the response, the
    others become revisit records without payload. Payloads are shuffled at most once, to meet the groups of
    equal ones, and not at all where these groups are few enough to broadcast.
    """
    folder = folder or f"{staging_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{payload}`").cast("string").alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    groups = rows.filter("same IS NOT NULL").groupBy("same").agg(F.count("*").alias("n"), F.max("id").alias("first"))
    rows = looked_up(rows, stage(groups.filter("n > 1 AND first IS NOT NULL")), "same")
    repeats = F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    rows = rows.select(F.col("id").cast("string"), "url", "payload", F.when(repeats, F.col("first")).cast("string").alias("first"))
    return stage(rows.mapInArrow(lambda batches: _written(batches, folder, date, archive_bytes), MANIFEST))


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _record_id(id: str | None, sha1: bytes) -> str:
    """The same for the same id and payload, so that a revisit can name its response without having met it."""
    return uuid.UUID(bytes=hashlib.sha1(f"{id}:".encode() + sha1).digest()[:16], version=5).urn


def _member(headers: list[tuple[str, str | None]], block: bytes, payload: bytes = b"") -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block) + len(payload)}\r\n\r\n".encode()
    return b"".join([packer.compress(head + block), packer.compress(payload), packer.compress(b"\r\n\r\n"), packer.flush()])


def page_record(id: str | None, url: str | None, payload: bytes, first: str | None, date: str = CRAWLED) -> bytes:
    """A page as a gzip member: a response, or where ``first`` names the page with the payload a revisit of it."""
    sha1 = hashlib.sha1(payload).digest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if first is None else b""
    whole = hashlib.sha1(block)
    whole.update(body)
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return _member([
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{_record_id(id, sha1)}>"),
        ("WARC-Date", date), ("WARC-Target-URI", uri), ("X-Page-ID", id),
        ("WARC-Refers-To", None if first is None else f"<{_record_id(first, sha1)}>"),
        ("WARC-Profile", None if first is None else PROFILE), ("WARC-Payload-Digest", _digest(sha1)),
        ("WARC-Block-Digest", _digest(whole.digest())), ("Content-Type", "application/http; msgtype=response"),
    ], block, body)


def info_record(name: str, date: str = CRAWLED) -> bytes:
    block = b"software: tallymark\r\nformat: WARC File Format 1.1\r\n"
    return _member([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{_record_id(name, b'')}>"), ("WARC-Date", date),
        ("WARC-Filename", name), ("WARC-Block-Digest", _digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/warc-fields")], block)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _written(batches: Iterator[pa.RecordBatch], folder: str, date: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The task's rows as archives under names of their own; a row of the list for each, after it is closed."""
    out, path, done = None, "", []
    system, root = _opened(folder)
    for ids, urls, payloads, firsts in chunks(batches, text=2):
        for id, url, payload, first in zip(ids, urls, payloads, firsts):
            if out is None:
                system.create_dir(root)
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, records, size = f"{folder}/{name}", 0, 0
                out = system.open_output_stream(f"{root}/{name}", compression=None)
                size += out.write(info_record(name, date))
            size += out.write(page_record(id, url, payload.encode(), first, date))
            records += 1
            if size >= limit:
                out.close()
                done.append((path, records, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, records, size))
    yield pa.RecordBatch.from_arrays([
        pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
        pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])


def archives_in(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """``(archive, bytes)`` of all archives below a folder, listed without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all ``archives`` (a staged table or listing with column ``archive``), but for archive information.

    Each archive is read from start to end by one task, ``BLOCK`` bytes at a time; no more than one record is
    held (none with ``payloads=False``). ``payload_digest`` is hexadecimal and computed from what was read, for revisit
    records as stated; ``payload_bytes`` is null for those. A record that cannot be unpacked, is cut short or
    disagrees with a digest has ``error`` set; reading goes on at the next record found.
    """
    parts = max(1, min(archives.count(), 20_000))
    spread = archives.select("archive").repartition(parts)
    return spread.mapInArrow(lambda batches: _read(batches, payloads), RECORDS)


def _read(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = _opened(path)
            with system.open_input_file(name) as file:
                for record in records(file, keep):
                    if record["type"] == "warcinfo":
                        continue
                    rows.append({"archive": path, **record})
                    held += 1000 + len(record["payload"] or b"")
                    if held >= KEPT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, RECORD)


def records(file, keep: bool = True) -> Iterator[dict]:
    """The records of an open archive in order; damaged ones with ``error``, after which the next member is searched."""
    source = _Source(file)
    while source.fill():
        start, framing, problem = source.at, _Framing(keep), None
        try:
            for block in source.member():
                framing.feed(block)
            problem = framing.close()
        except (zlib.error, EOFError) as e:
            problem = f"damaged member: {e}"
            source.seek_member(start + 1)
        except ValueError as e:
            problem = str(e)
            source.seek_member(start + 1)
        yield {"start": start, **framing.record(problem), "error": problem}


class _Source:
    """Gzip members of a file, unpacked as they are read; ``at`` is the place of the first byte not yet unpacked."""

    def __init__(self, file):
        self.file, self.ahead, self.at = file, b"", 0

    def fill(self) -> bool:
        if not self.ahead:
            self.ahead = self.file.read(BLOCK)
        return bool(self.ahead)

    def member(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.fill():
                raise EOFError("the file ends within it")
            given = self.ahead
            block = unpack.decompress(given, BLOCK)  # whatever is packed, no more than a block comes out at once
            self.ahead = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self.at += len(given) - len(self.ahead)
            yield block

    def seek_member(self, at: int) -> None:
        """Go to the next place from ``at`` on where a member begins that unpacks to a WARC record, or to the end."""
        self.file.seek(at)
        self.at, self.ahead = at, b""
        while True:
            more = self.file.read(BLOCK)
            self.ahead += more
            found = self.ahead.find(b"\x1f\x8b\x08")
            if found >= 0 and (len(self.ahead) - found >= 1024 or not more):
                self.at, self.ahead = self.at + found, self.ahead[found:]
                try:
                    if zlib.decompressobj(31).decompress(self.ahead[:1024], 5).startswith(b"WARC/"):
                        return
                except zlib.error:
                    pass
                self.at, self.ahead = self.at + 1, self.ahead[1:]
            elif not more:
                self.at, self.ahead = self.at + len(self.ahead), b""
                return
            elif found < 0:
                self.at, self.ahead = self.at + len(self.ahead) - min(2, len(self.ahead)), self.ahead[-2:]


class _Framing:
    """One record, framed by its Content-Length, from blocks as they come."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.headers = keep, b"", None
        self.length = self.seen = self.size = 0
        self.block, self.digest, self.payload = hashlib.sha1(), hashlib.sha1(), []
        self.http, self.trailer = None, b""  # bytes of the HTTP head so far; None where the block is all payload

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n", max(0, len(self.head) - len(data) - 3))
            if end < 0:
                if not b"WARC/".startswith(self.head[:5]) and not self.head.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                return
            data, head = self.head[end + 4:], self.head[:end]
            self._begin(head)
        body = data[: self.length - self.seen]
        if body:
            self.seen += len(body)
            self.block.update(body)
            self._content(body)
        self.trailer = (self.trailer + data[len(body):])[:5]

    def _begin(self, head: bytes) -> None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.head, self.headers = b"", {}
        for line in lines:
            name, colon, value = line.partition(":")
            if colon:
                self.headers.setdefault(name.strip().lower(), value.strip())
        length = self.headers.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,18}", length):
            raise ValueError("no Content-Length")
        self.length = int(length)
        if self.headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            self.http = b""

    def _content(self, body: bytes) -> None:
        if self.http is not None:
            searched = max(0, len(self.http) - 3)
            self.http += body
            end = self.http.find(b"\r\n\r\n", searched)
            if end < 0:
                return
            body, self.http = self.http[end + 4:], None
        self.digest.update(body)
        self.size += len(body)
        if self.keep:
            self.payload.append(body)

    def close(self) -> str | None:
        """What is wrong with the whole record, or None."""
        if self.headers is None:
            return "not a WARC record"
        if self.seen < self.length:
            return "shorter than its Content-Length"
        if self.trailer != b"\r\n\r\n":
            return "not closed after its Content-Length"
        if not _agree(self.headers.get("warc-block-digest"), self.block):
            return "block digest differs"
        if self.headers.get("warc-type") != "revisit" and not _agree(self.headers.get("warc-payload-digest"), self.digest):
            return "payload digest differs"
        return None

    def record(self, problem: str | None) -> dict:
        headers = self.headers or {}
        revisit = headers.get("warc-type") == "revisit"
        stated = headers.get("warc-payload-digest", "") if revisit else ""
        return {
            "type": headers.get("warc-type"), "record_id": _bare(headers.get("warc-record-id")), "id": headers.get("x-page-id"),
            "url": headers.get("warc-target-uri"), "refers_to": _bare(headers.get("warc-refers-to")),
            "payload_bytes": None if revisit or problem else self.size,
            "payload_digest": (_hex(stated) if revisit else self.digest.hexdigest()) if problem is None else None,
            "payload": b"".join(self.payload) if self.keep and not revisit and problem is None else None}


def _bare(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<").removesuffix(">")


def _hex(stated: str) -> str | None:
    """A stated SHA-1, in base 32 or hexadecimal, as lower-case hexadecimal; None for other digests."""
    name, _, value = stated.partition(":")
    if name.strip().lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _agree(stated: str | None, found) -> bool:
    """False only where a SHA-1 is stated and differs; other digests are not verified."""
    wanted = _hex(stated or "")
    return wanted is None or wanted == found.hexdigest()


def resolved(records: DataFrame) -> DataFrame:
    """Staged ``records`` with ``refers_to`` as the id of the response meant, and its size and payload for revisits.

    A revisit whose response is not among the records keeps nulls there.
    """
    revisits = records.filter("type = 'revisit' AND refers_to IS NOT NULL")
    wanted = revisits.groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n"))
    responses = records.filter("type = 'response' AND error IS NULL").select(
        "record_id", F.struct(F.col("id"), F.col("payload_bytes"), F.col("payload")).alias("response"))
    met = responses.join(wanted, "record_id").groupBy(F.col("record_id").alias("refers_to"), "n")
    met = stage(met.agg(F.any_value("response").alias("response")))
    rows = looked_up(records, met, "refers_to")
    own = {"refers_to": F.col("response.id"), **{
        c: F.when(F.col("type") == "revisit", F.col(f"response.{c}")).otherwise(F.col(c)) for c in ("payload_bytes", "payload")}}
    return rows.select(*[own[c].alias(c) if c in own else F.col(c) for c in records.columns])
