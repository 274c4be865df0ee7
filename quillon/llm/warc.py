"""WARC archives: a writer, and a salvage reader that survives damage.

Archives are gzip members, one record each, written through Spark's committer
by the text writer: the record bytes travel as a string column that is never
re-encoded, and the line separator is an empty gzip member, so a file is a
valid concatenation of members and any Hadoop file system can hold it.

Records with equal payloads share one response; the others are revisits that
name it. Which payloads repeat is known from narrow digests before any record
is built. Files are cut by the bytes of their members.

The salvage reader checks each member (magic, deflate stream, CRC, length) and
each record (version line, header, length, payload digest). After a failed
check it searches for the next offset where a member's magic or a version line
starts a readable record, goes on there, and logs the bytes between as a
quarantined gap. Uncompressed archives, and ones with both kinds of records,
are read the same way.

Defined cases: a null payload is empty and so a response or revisit like any
other; payloads under `least` bytes are all responses; equal payloads with the
same smallest id keep one response for each row of that id; a null id is
written as `null` and read back so; a null url is empty; other columns are
ignored; no rows write no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, shared_dir, stored

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Bytes that one archive file holds, unless its one record has more; a file is one row of the reader.
FILE_BYTES = 8 << 20
#: Ways in which rows of one digest are spread where the groups are too large to broadcast.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"


def member(data: bytes) -> bytes:
    """data as one gzip member, the same bytes every time."""
    squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeezed.compress(data) + squeezed.flush()


EMPTY_MEMBER = member(b"")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit names its response and leaves the payload out."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """What a record says; offset is where its member (or version line) starts."""

    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Salvage:
    """Records that passed their checks, and (offset, length, reason) of what did not."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The plain record at `at`, its end, or what is wrong with it."""
    if data[at : at + len(VERSION)] not in (VERSION, b"WARC/1.0\r\n"):
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "header cut off"
    headers: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None, at, "bad content length"
    start = head + 4
    end = start + int(length)
    if end + 4 > len(data):
        return None, at, "block cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no record end"
    block = data[start:end]
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != base32_sha1(block):
        return None, at, "payload digest differs"
    return Record(at, headers, block), end + 4, ""


def _inflate(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    """The gzip member at `at` and its end."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data[at:]) if at else z.decompress(data)
    except zlib.error as e:
        return None, at, f"bad member: {str(e)[:60]}"
    if not z.eof:
        return None, at, "member cut off"
    return out, len(data) - len(z.unused_data), ""


def _unit(data: bytes, at: int) -> tuple[list[Record] | None, int, str]:
    """The member or plain record at `at`."""
    if data.startswith(MAGIC, at):
        plain, end, why = _inflate(data, at)
        if plain is None:
            return None, at, why
        found, inner = [], 0
        while inner < len(plain):
            rec, inner_end, why = _parse(plain, inner)
            if rec is None:
                return None, at, why
            rec.offset = at
            found.append(rec)
            inner = inner_end
        return found, end, ""
    rec, end, why = _parse(data, at)
    return (None, at, why) if rec is None else ([rec], end, "")


_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes, window: int = 1 << 20) -> Salvage:
    """All readable records of an archive, and the gaps between them.

    The archive is walked through a sliding view, so inflating one member never
    copies the rest of the file.
    """
    out = Salvage()
    at, bad, reason = 0, -1, ""
    while at < len(data):
        size = window
        while True:
            found, end, why = _unit(data[at : at + size], 0)
            if found is not None or at + size >= len(data) or "cut off" not in why:
                break
            size *= 4
        if found is None:
            if bad < 0:
                bad, reason = at, why
            following = _STARTS.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad >= 0:
            out.gaps.append((bad, at - bad, reason))
            bad = -1
        for rec in found:
            rec.offset += at
            out.records.append(rec)
        at += end
    if bad >= 0:
        out.gaps.append((bad, len(data) - bad, reason))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> str:
    """Write a record for each row to files under path."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    source = source.select("id", "url", "body", F.unhex(F.sha1("body")).alias("digest"), F.octet_length("body").alias("bytes"))
    narrow = source.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(narrow.where("n > 1 and first is not null").select("digest", "bytes", "first"), "groups")
    if is_small(groups):
        known = source.join(F.broadcast(groups), ["digest", "bytes"], "left")
    else:  # a payload that a third of all pages have must not meet in one task
        salted = source.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        known = salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "bytes", "salt"], "left")
    refers_to = F.when(F.col("id") != F.col("first"), F.col("first"))
    known = known.select(F.col("id").cast("string").alias("id"), "url", "body", refers_to.cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for pdf in batches:
            for page, url, body, to in zip(pdf["id"], pdf["url"], pdf["body"], pdf["refers_to"], strict=True):
                one = member(record(page or "null", url, body.encode(), to))
                if out and size + len(one) > FILE_BYTES:
                    yield pd.DataFrame({"members": [b"".join(out)]})
                    out, size = [], 0
                out.append(one)
                size += len(one)
        if out:
            yield pd.DataFrame({"members": [b"".join(out)]})

    # a row is what a file holds, so files are cut by their bytes
    members = known.mapInPandas(run, "members binary").select(F.col("members").cast("string").alias("value"))
    separator = EMPTY_MEMBER.decode("latin-1")
    members.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record or gap: file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to, gap_bytes, reason."""

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                found = salvage(content)
                rows = []
                for r in found.records:
                    kind = r.headers.get("warc-type", "")
                    whole = kind == "response"
                    size = len(r.block) if whole else int(r.headers.get("x-payload-length", "0"))
                    digest = base32_sha1(r.block) if whole else r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((file, r.offset, number(r.headers.get("warc-record-id")), size, digest, kind, number(r.headers.get("warc-refers-to")), None, None))
                rows += [(file, at, None, None, None, None, None, size, why) for at, size, why in found.gaps]
                frame = pd.DataFrame(rows, columns=["file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap_bytes", "reason"])
                yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "gap_bytes": "Int64", "offset": "int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_bytes long, reason string")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the pages' archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", **options)
    return read_archives(spark, path)
