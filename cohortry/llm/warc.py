"""WARC archives: written as gzip members with revisit records, read back by a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, broadcast_if_small, ready

# Payloads from this size on are stored once.
REVISIT_BYTES = 100
# Records of one file: a file is read as a whole by one task.
FILE_RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r?\n")
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def encode_record(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None = None,
                  length: int | None = None) -> bytes:
    """One uncompressed record: a response, or without payload a revisit of another record.

    The HTTP header keeps the length of the full payload in both kinds.
    """
    size = len(payload) if length is None else length
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    """Quarantined bytes of a file: from ``offset`` up to ``end``."""

    offset: int
    end: int
    reason: str
    inside: int | None = field(default=None)  # offset of the member, where the gap lies in its decompressed bytes


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def _one_record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record that begins at ``at`` and where it ends, or why it is none."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header without end"
    headers = _fields(data[at:stop].split(b"\r\n")[1:])
    if not headers.get("content-length", "").isdecimal() or not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        return None, at, "header without a mandatory field"
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return None, at, "record without end"
    block = data[begin:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha256:") and hashlib.sha256(block).hexdigest() != stated[7:].lower():
        return None, at, "block digest differs"
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        top, split, payload = block.partition(b"\r\n\r\n")
        if not split:
            return None, at, "HTTP header without end"
        http = _fields(top.split(b"\r\n")[1:])
    stated = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and stated.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != stated[7:].lower():
        return None, at, "payload digest differs"
    return Record(at, headers, http, payload), end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    """The content of the gzip member at ``at`` and where it ends, or why it is none."""
    engine, parts, begin, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not engine.eof:
            chunk = view[at:at + 65536]
            if not len(chunk):
                return None, begin, "member without end"
            parts.append(engine.decompress(chunk))
            at += len(chunk)
    except zlib.error as error:
        return None, begin, f"member: {error}"
    return b"".join(parts), at - len(engine.unused_data), ""


def _next_place(data: bytes, at: int, members: bool) -> int:
    """Where after ``at`` the next whole record (or member) stands; the end if nowhere."""
    member, line = data.find(_MAGIC, at + 1) if members else -1, _VERSION.search(data, at + 1)
    while member >= 0 or line:
        if line is None or 0 <= member < line.start():
            if _member(data, member)[0] is not None:
                return member
            member = data.find(_MAGIC, member + 1)
        else:
            if _one_record(data, line.start())[0] is not None:
                return line.start()
            line = _VERSION.search(data, line.start() + 1)
    return len(data)


def salvage(data: bytes, inside: int | None = None) -> Iterator[Record | Gap]:
    """All records of a file that pass their checks, and the byte gaps between them, in file order.

    Members and plain records may alternate. After a member that does not
    decompress, or a record whose framing or digest fails, the search goes on
    byte by byte for the next place where a whole member or record stands.
    ``inside`` is the offset of the member whose content ``data`` is.
    """
    at = 0
    while at < len(data):
        if inside is None and data[at:at + 3] == _MAGIC:
            content, end, reason = _member(data, at)
            if content is not None:
                yield from salvage(content, at)
                at = end
                continue
        else:
            record, end, reason = _one_record(data, at)
            if record is not None:
                record.offset = at if inside is None else inside
                yield record
                at = end
                continue
        begin, at = at, _next_place(data, at, inside is None)
        yield Gap(begin, at, reason, inside)


def write_archives(pages: DataFrame, path: str, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record per page: gzip members, payload the html in UTF-8 (null: empty).

    Of pages with equal payloads of REVISIT_BYTES or more the one with the
    smallest key is a response, the others revisit it. Rows that share key and
    payload are written alike. Only digests meet to find the copies; the table of
    revisits is broadcast where a count shows that it is small, else pages are
    joined with it by key. Files are written by Spark's own committer, so a lost
    task leaves no half file.
    """
    ready(pages.sparkSession)
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    hashed = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"),
                          F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    large = hashed.where((F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    revisits = scratch.store(large.join(firsts, "digest").where("id <> first").distinct())
    marked = hashed.join(broadcast_if_small(revisits.withColumnRenamed("first", "refers")), ["id", "digest"], "left")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda n: f"urn:page:{'' if n is None else n}"
        for batch in batches:
            members = [
                gzip.compress(encode_record(name(r["id"]), r["url"], r["body"], r["digest"], None if r["refers"] is None else name(r["refers"]), r["size"]), 6, mtime=0)
                for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    members = marked.select("id", "url", "body", "digest", "size", "refers").mapInArrow(encode, "member binary")
    # The text sink writes bytes as they are; what it puts after each row is a member without content.
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path``.

    Columns: file, offset, kind (``record`` or ``gap``), end and reason (gaps),
    record_type, record_id, refers_to, url, payload_digest, payload_bytes,
    payload (null unless ``payloads``, and for revisits). Digests are checked;
    for a revisit payload_bytes is the length its HTTP header states.
    """
    ready(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("reason", pa.string()),
                           ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
                           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for found in salvage(content.as_py()):
                    if isinstance(found, Gap):
                        rows.append({"file": file, "offset": found.offset if found.inside is None else found.inside, "kind": "gap",
                                     "end": found.end, "reason": found.reason})
                        continue
                    h = found.headers
                    revisit = h["warc-type"] == "revisit"
                    length = found.http.get("content-length", "") if revisit else ""
                    rows.append({
                        "file": file, "offset": found.offset, "kind": "record", "record_type": h["warc-type"],
                        "record_id": h.get("warc-record-id", "").strip("<>"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
                        "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        "payload_bytes": (int(length) if length.isdecimal() else None) if revisit else len(found.payload),
                        "payload": found.payload if payloads and not revisit else None})
                    size += len(found.payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, offset long, kind string, end long, reason string, record_type string, record_id string, "
                                  "refers_to string, url string, payload_digest string, payload_bytes long, payload binary")
