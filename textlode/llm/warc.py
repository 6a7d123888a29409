"""WARC archives: a writer, and a reader that goes on behind damage.

The reader checks each record (compressed member, head, length, digests in hex or
base32); a member may hold several records.  After a failed check it searches for the next valid member or version line, goes on with
the records from there and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.plans.storage import new_folder

from .components import stored
from .files import create, reader, task_file

VERSION = b"WARC/1.1"
#: Payloads of at least so many bytes may be revisits.
REVISIT_BYTES = 1000
#: A file is closed with the record that reaches so many compressed bytes.
FILE_BYTES = 64 * 1024 * 1024
#: Bytes read at a time.
CHUNK = 1 << 18
NAMES = uuid.UUID("5f1d3d0e-8c0a-4c0f-9b39-1c5c5a1e7a42")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_MEMBER = b"\x1f\x8b\x08"
#: No head is longer.
HEAD_BYTES = 1 << 24


class Damage(ValueError):
    """A check of a record failed."""


# -- writing ---------------------------------------------------------------
def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page_id))}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", value)


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None
) -> bytes:
    """One record: the payload behind its HTTP head, of a revisit only the head."""
    digest = f"sha1:{hashlib.sha1(payload).hexdigest()}"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_name(page_id)),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url or "urn:page:unknown")),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_name(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return b"".join([VERSION, b"\r\n", lines, b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads the largest page is referred to.

    Only digests are compared and counted; the page texts are shuffled once.  Rows that
    repeat the largest page are responses too, rows without an identifier always are.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    large = own.select("page_id", F.sha1(body).alias("digest"), F.octet_length("html").alias("n"))
    large = large.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")
    )
    copies = large.select("page_id", "digest").join(groups.where("n > 1").select("digest", "refers_to"), "digest")
    copies = copies.where("page_id <> refers_to").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"
    )
    copies = copies.distinct()
    same = (F.col("page_id") == F.col("_page")) & (F.sha1(body) == F.col("_digest"))
    return own.join(copies, same, "left").select("page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of :func:`mark_revisits`; (path, records, bytes) of each file.

    Each record is a compressed member of its own.  A repeated attempt of a task writes
    files of another name, and only those of the attempt that Spark keeps are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row = None, {}
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    row = {"path": task_file(folder, ".warc.gz"), "records": 0, "bytes": 0}
                    out = create(row["path"])
                data = member(record(page, url, html.encode("utf-8"), refers))
                out.write(data)
                row["records"] += 1
                row["bytes"] += len(data)
                if row["bytes"] >= file_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pylist([row])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([row])

    return stored(marked.mapInArrow(run, "path string, records long, bytes long"), "archives")


# -- reading ---------------------------------------------------------------
@dataclass(frozen=True)
class Record:
    """A record and the bytes of its member; records of one member share them."""

    start: int
    end: int
    head: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Quarantined bytes and the check that failed at their beginning."""

    start: int
    end: int
    reason: str


class Source:
    """Bytes of a file by position, read in chunks."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, 2)
        self.buffer, self.start = b"", 0

    def read(self, at: int, n: int) -> bytes:
        begin = at - self.start
        if begin < 0 or begin + n > len(self.buffer):
            self.file.seek(at)
            self.buffer, self.start = self.file.read(max(n, CHUNK)), at
            begin = 0
        return self.buffer[begin : begin + n]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Head and block of the record at a position of ``data``, and where it ends."""
    line = _LINE.match(data, at)
    if not line:
        raise Damage("no version line")
    stop = _HEAD_END.search(data, line.end() - 2)
    if not stop:
        raise Damage("head without end")
    head = {}
    for row in data[line.end() : stop.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = row.partition(":")
        if not colon:
            raise Damage("head line without colon")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise Damage("no content length")
    end = stop.end() + int(head["content-length"])
    block = data[stop.end() : end]
    if len(block) < int(head["content-length"]):
        raise Damage("block cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("record without end")
    check_digest(head.get("warc-block-digest"), block, "block digest")
    if head.get("warc-type") == "response":
        check_digest(head.get("warc-payload-digest"), payload(block), "payload digest")
    return head, block, end + 4


def payload(block: bytes) -> bytes:
    """Body behind the HTTP head of a block."""
    return block.partition(b"\r\n\r\n")[2]


def check_digest(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:"):
        if hashlib.sha1(data).hexdigest() != hex_digest(stated):
            raise Damage(f"wrong {what}")


def hex_digest(stated: str) -> str:
    """A ``sha1:`` digest in lower-case hex, also if it is stated in base32."""
    _, _, value = stated.partition(":")
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return value.lower()
    return value.lower()


def _inflate(source: Source, at: int, most: int | None = None) -> tuple[bytes, int]:
    """Content and end of the compressed member at a position; at most its first bytes."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            chunk = source.read(pos, min(CHUNK, source.size - pos))
            if not chunk:
                raise Damage("member cut off")
            out.append(unpack.decompress(chunk, most or 0))
            pos += len(chunk)
            if most and sum(map(len, out)) >= most:
                break
    except zlib.error as error:
        raise Damage("damaged member") from error
    return b"".join(out), pos - len(unpack.unused_data)


def _plain(source: Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record of an archive that is not compressed, at a position."""
    data = source.read(at, min(CHUNK, source.size - at))
    stop, size = _HEAD_END.search(data), CHUNK
    while not stop and _LINE.match(data) and size < min(HEAD_BYTES, source.size - at):
        size *= 2
        data = source.read(at, min(size, source.size - at))
        stop = _HEAD_END.search(data)
    length = re.search(rb"(?i)\ncontent-length:[ \t]*(\d+)", data[: stop.end()] if stop else b"")
    need = stop.end() + int(length[1]) + 4 if length else 0
    if length and need > len(data):
        if at + need > source.size:
            raise Damage("block cut off")
        data = source.read(at, need)
    return parse(data)


def _records_at(source: Source, at: int) -> list[Record | Gap]:
    """The record at a position, or all of the member there, with a gap for what is damaged."""
    if source.read(at, 3) != _MEMBER:
        head, block, size = _plain(source, at)
        return [Record(at, at + size, head, block)]
    data, end = _inflate(source, at)
    found: list[Record | Gap] = []
    inside, reason = 0, ""
    while inside < len(data):
        try:
            head, block, inside = parse(data, inside)
            found.append(Record(at, end, head, block))
        except Damage as error:
            reason = reason or str(error)
            line = _LINE.search(data, inside + 1)
            inside = line.start() if line else len(data)
    if not found:
        raise Damage(reason or "member without record")
    return [*found, Gap(at, end, f"in a member of several records: {reason}")] if reason else found


def _next_start(source: Source, at: int) -> int:
    """Next position that may begin a record: a member that holds one, or a version line."""
    overlap = 12
    while at < source.size:
        data = source.read(at, min(CHUNK, source.size - at))
        found = [m.start() for m in _LINE.finditer(data)]
        place = data.find(_MEMBER)
        while place >= 0:
            found.append(place)
            place = data.find(_MEMBER, place + 1)
        for offset in sorted(found):
            here = at + offset
            if data[offset : offset + 3] != _MEMBER:
                return here
            try:
                first, _ = _inflate(source, here, len(VERSION))
            except Damage:
                continue
            if first.startswith(b"WARC/1."):
                return here
        if at + len(data) >= source.size:
            break
        at += max(1, len(data) - overlap)
    return source.size


def salvage(file) -> Iterator[Record | Gap]:
    """Records of an archive in order, and a gap wherever bytes had to be left out.

    An empty file gives nothing.  A gap ends where the next record passes all checks.  If
    only some records of a member do, these are followed by a gap of the member's bytes.
    """
    source = Source(file)
    at, bad, reason = 0, None, ""
    while at < source.size:
        try:
            found = _records_at(source, at)
        except Damage as error:
            if bad is None:
                bad, reason = at, str(error)
            at = _next_start(source, at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield from found
        at = found[-1].end
    if bad is not None:
        yield Gap(bad, source.size, reason)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record and each gap of the files in the column ``path``.

    (path, start, end, gap, page_id, url, record_type, refers_to, payload,
    payload_bytes, payload_digest); ``gap`` has the failed check, else null.  Size and
    digest of a revisit are those its head states for the full payload.
    """
    listed = archives.select("path")
    n = max(1, listed.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reader(path) as file:
                    held, size = [], 0
                    for found in salvage(file):
                        held.append(_row(path, found))
                        size += found.end - found.start
                        if size > CHUNK or len(held) >= 500:
                            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    return listed.repartition(n).mapInArrow(
        run,
        "path string, start long, end long, gap string, page_id long, url string, "
        "record_type string, refers_to long, payload binary, payload_bytes long, "
        "payload_digest string",
    )


_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()),
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def _row(path: str, found: Record | Gap) -> dict:
    row = {"path": path, "start": found.start, "end": found.end}
    if isinstance(found, Gap):
        return row | {"gap": found.reason}
    head, body = found.head, payload(found.block)
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    revisit = head.get("warc-type") == "revisit"
    stated = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", found.block.partition(b"\r\n\r\n")[0])
    return row | {
        "page_id": int(page) if page else None,
        "url": head.get("warc-target-uri"),
        "record_type": head.get("warc-type"),
        "refers_to": int(refers) if refers else None,
        "payload": None if revisit else body,
        "payload_bytes": int(stated[1]) if revisit and stated else len(body),
        "payload_digest": hex_digest(head.get("warc-payload-digest") or "")
        if revisit
        else hashlib.sha1(body).hexdigest(),
    }


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of written and reread pages.

    A null page has an empty payload; pages of fewer than 1000 bytes are responses.
    """
    folder = new_folder(pages.sparkSession, "warc")
    records = read_archives(write_archives(mark_revisits(pages), folder))
    return records.where("gap IS NULL").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
