"""WARC archives: a writer with revisit records, and a salvage reader.

Each record is a gzip member of its own. Of pages with equal payloads of ``least`` bytes
or more the one with the largest page_id is stored, the others become revisit records
whose HTTP header still tells the length.

The reader checks every record: gzip checksum, version line, header lines, length, the
closing blank lines and the payload digest. When a check fails it does not give up
the file: it looks for the next gzip signature or version line that begins a record
passing all checks, goes on there, and reports the bytes between as a gap with the first
reason. It reads forward through a window no larger than a record.

A gzip member may hold many records. It is unpacked twice as a stream, once for its
checksum and once for its records. In a sound member the search for the next version
line goes on in the unpacked bytes; the gap tells its place there. A member that breaks
off or cannot be unpacked to its end gives the records before the fault that another
version line follows; one with a wrong checksum gives none, as any byte of it may differ.

Files lie in the shared folder, one or more a task, written under a name of their own and
listed only by tasks that end well; a repeated task leaves an unlisted file behind, which
nobody reads. Paths go to pyarrow's file systems (file, hdfs, s3, gs).

A NULL payload counts as empty. Pages with a NULL page_id can only be revisits or stand
alone. Repeated rows are written again; two rows that both have the largest page_id are
both stored. Line breaks in a URL are percent-encoded; a NULL URL is left out. An empty
table gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, stored, table, text_slices
from sitelab.llm.registry import query
from sitelab.session import new_path

LEAST = 1000
#: A file is closed after about this many bytes.
FILE_BYTES = 64 << 20
#: A block that claims to be larger is not believed: a string of Spark and its HTTP header are less.
MOST = (1 << 31) + (1 << 16)
#: Bytes of a header looked at first; there is no bound to its length.
HEADER = 64 << 10
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:x-page:"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_SIGNATURE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_LINE = re.compile(rb"WARC/1\.")


# Writing


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, digest: str | None = None) -> bytes:
    """One record, uncompressed."""
    digest = digest or hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [
            f"WARC-Refers-To: <{PAGE}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, stream, size, count, done = "", None, 0, 0, []

        def close() -> None:
            if stream is not None:
                stream.close()
                done.append((name, count, size))

        for whole in batches:
            for batch in text_slices(whole, "payload"):
                for page_id, url, payload, refers_to, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None or size >= file_bytes:
                        close()
                        name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    packed = member(record_bytes(page_id, url, payload, refers_to, digest))
                    stream.write(packed)
                    size, count = size + len(packed), count + 1
        close()
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()),
                "records": pa.array([c for _, c, _ in done], pa.int64()),
                "bytes": pa.array([b for _, _, b in done], pa.int64()),
            }
        )

    return run


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to, digest): refers_to is NULL for records that are stored whole."""
    rows = checked_columns(pages, {"page_id": "long", "url": "string", "html": "string"}).select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    stays = (
        rows.filter(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("stays"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("stays").isNotNull())
        .drop("n")
    )
    other = F.when(~F.col("page_id").eqNullSafe(F.col("stays")), F.col("stays"))
    return rows.join(stays, ["digest", "size"], "left").select("page_id", "url", "payload", other.alias("refers_to"), "digest")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; the manifest (path, records, bytes) of the files that count."""
    written = with_revisits(pages, least).mapInArrow(_writer(folder, file_bytes), "path string, records long, bytes long")
    return stored(written, "warc-manifest")


# Reading


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


class Broken(Exception):
    """A failed check; the text is the reason."""


class _Window:
    """A forward view of a stream that forgets what lies behind."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.base, self.data, self.ended = stream, 0, bytearray(), False

    def reach(self, end: int) -> bool:
        """Whether the stream has bytes up to ``end``."""
        while not self.ended and self.base + len(self.data) < end:
            more = self.stream.read(CHUNK)
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= end

    def get(self, start: int, end: int) -> bytes:
        self.reach(end)
        return bytes(self.data[start - self.base : end - self.base])

    def forget(self, start: int) -> None:
        if start - self.base >= CHUNK or self.ended:
            del self.data[: start - self.base]
            self.base = start

    def back(self, start: int) -> None:
        """Go back to ``start``, which may be forgotten by now."""
        if start < self.base:
            self.stream.seek(start)
            self.base, self.data, self.ended = start, bytearray(), False

    def find(self, start: int, sign: re.Pattern = _SIGNATURE) -> int | None:
        """The next place at or after ``start`` that looks like the beginning of a record."""
        while True:
            self.reach(start + CHUNK)
            hit = sign.search(self.data, start - self.base)
            if hit:
                return self.base + hit.start()
            if self.ended:
                return None
            start = max(start, self.base + len(self.data) - 7)
            self.forget(start)


def parse_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``start`` of a buffer that holds it whole."""
    if not _VERSION.match(data, start):
        raise Broken("no version line")
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        raise Broken("unended header")
    headers = {}
    for line in data[start:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken("header line without a name")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not MANDATORY <= headers.keys():
        raise Broken("mandatory header missing")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,12}", length) or int(length) > MOST:
        raise Broken("no believable length")
    end = stop + 4 + int(length)
    if end + 4 > len(data):
        raise Broken("truncated")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("no blank lines after the block")
    return headers, bytes(data[stop + 4 : end]), end + 4


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The length told by the HTTP header of a block, and the payload that is there."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        raise Broken("no HTTP header")
    told = re.search(rb"(?i)^content-length:[ \t]*([0-9]{1,12})[ \t]*\r?$", head, re.M)
    return (int(told[1]) if told else len(payload)), payload


def _check_digest(headers: dict[str, str], block: bytes) -> None:
    told = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "response" or not told.lower().startswith("sha1:"):
        return
    length, payload = payload_of(block)
    if length != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told[5:]:
        raise Broken("payload digest differs")


def _plain(window: _Window, start: int) -> Record:
    size = HEADER
    while True:
        data = window.get(start, start + size)
        stop = data.find(b"\r\n\r\n")
        if stop >= 0 or len(data) < size:
            break
        # A long header goes on only as long as its lines are header lines.
        if not _VERSION.match(data) or any(b":" not in line for line in data.split(b"\r\n")[1:-1]):
            raise Broken("unended header")
        size *= 2
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,12})[ \t]*\r?$", data[: max(stop, 0)])
    if stop >= 0 and length and int(length[1]) <= MOST:
        data = window.get(start, start + stop + 8 + int(length[1]))
    headers, block, size = parse_record(data)
    _check_digest(headers, block)
    return Record(start, start + size, headers, block)


class _Unpacked:
    """The content of the gzip member at ``start`` as a stream; ``fault`` tells why it ended early."""

    PIECE = 1 << 16
    #: With ``to_the_byte``; less than the mandatory headers of a record take.
    SMALL = 64

    def __init__(self, window: _Window, start: int, to_the_byte: bool = False):
        window.back(start)
        self.window, self.start, self.at, self.tail, self.fault, self.to_the_byte = window, start, start, b"", "", to_the_byte
        self.unpacker, self.total, self.marks = zlib.decompressobj(31), 0, deque([(0, start)])

    def read(self, size: int) -> bytes:
        while not self.unpacker.eof and not self.fault:
            piece = self.tail or self.window.get(self.at, self.at + (self.SMALL if self.to_the_byte else self.PIECE))
            if not piece:
                self.fault = "truncated gzip member"
                break
            if not self.tail:
                if self.to_the_byte:
                    self.marks.append((self.total, self.at))
                self.at += len(piece)
                # A member of a few chunks stays in the window, so that nothing is read again.
                if self.at - self.start > 4 * CHUNK:
                    self.window.forget(self.at)
            before = self.unpacker.copy() if self.to_the_byte else None
            try:
                out = self.unpacker.decompress(piece, size)
                self.tail = self.unpacker.unconsumed_tail
            except zlib.error as fault:
                wrong = re.search("incorrect (data|length) check", str(fault))
                self.fault = "wrong checksum of a gzip member" if wrong else "damaged gzip member"
                out = self._up_to_the_fault(before, piece) if before else b""
            self.total += len(out)
            if out:
                return out
        return b""

    def _up_to_the_fault(self, unpacker, piece: bytes) -> bytes:
        out = []
        try:
            for i in range(len(piece)):
                out.append(unpacker.decompress(piece[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out)

    def place(self, unpacked: int) -> int:
        """The place in the file of an unpacked byte, rounded down to a piece; asked for ascending bytes."""
        while len(self.marks) > 1 and self.marks[1][0] <= unpacked:
            self.marks.popleft()
        return self.marks[0][1]

    def end(self) -> int:
        """Unpack to the end; the place after the member."""
        while self.read(CHUNK):
            pass
        return self.at - len(self.unpacker.unused_data)


def _member(window: _Window, start: int) -> Iterator[Record | Gap]:
    """Records and gaps of the member at ``start``; all bear the place of the member in the file, as far as it is read."""
    first = _Unpacked(window, start)
    end, fault = first.end(), first.fault
    if fault.startswith("wrong checksum"):
        raise Broken(fault)
    unpacked = _Unpacked(window, start, bool(fault))
    inner, at, bad, reason, held = _Window(unpacked), 0, None, "", None
    while inner.reach(at + 1):
        if held and inner.get(at, at + 7) == b"WARC/1.":
            yield held
            held = None
        try:
            record = _plain(inner, at)
        except Broken as broken:
            if bad is None:
                bad, reason = at, str(broken)
            at = inner.find(at + 1, _LINE)
            if at is None:
                at = inner.base + len(inner.data)
                break
        else:
            if held:
                yield held
            if bad is not None:
                yield Gap(start, unpacked.place(at) if fault else end, f"{reason}, bytes {bad} to {at} of the member")
                bad = None
            at = record.end
            held = Record(start, unpacked.place(at) if fault else end, record.headers, record.block)
        inner.forget(at)
    if fault:
        raise Broken(fault)
    if held:
        yield held
    elif bad is None:
        raise Broken("empty gzip member")
    if bad is not None:
        yield Gap(start, end, f"{reason}, bytes {bad} to {at} of the member")


def salvage(stream: BinaryIO) -> Iterator[Record | Gap]:
    """Records and gaps of one archive, compressed or not, in the order of their bytes; ``stream`` can seek."""
    window, at, bad, reason = _Window(stream), 0, None, ""
    while window.reach(at + 1):
        end = at
        try:
            first = window.get(at, at + 7)
            if first[:3] == b"\x1f\x8b\x08":
                found = _member(window, at)
            elif first == b"WARC/1.":
                found = iter([_plain(window, at)])
            else:
                raise Broken("neither a gzip member nor a version line")
            for one in found:
                if bad is not None:
                    yield Gap(bad, at, reason)
                    bad = None
                yield one
                end = one.end
        except Broken as fault:
            # Of a member that gave records the rest is searched.
            if bad is None:
                bad, reason = end, str(fault)
            at = max(end, at + 1)
            window.back(at)
            found = window.find(at)
            if found is None:
                at = window.base + len(window.data)
                break
            at = found
        else:
            at = end
            window.back(at)
        window.forget(at)
    if bad is not None:
        yield Gap(bad, at, reason)


_ROW = pa.schema(
    [
        ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()),
        ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
ROW = "path string, start long, end long, gap string, page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{PAGE}(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def _row(path: str, found: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(found, Gap):
        return (path, found.start, found.end, found.reason, None, None, None, None, None, None, None)
    h = found.headers
    kind = h.get("warc-type")
    try:
        size, payload = payload_of(found.block)
    except Broken:
        size, payload = len(found.block), found.block
    digest = hashlib.sha1(payload).hexdigest()
    told = h.get("warc-payload-digest", "")
    if kind == "revisit":
        digest = base64.b32decode(told[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", told) else None
    return (
        path, found.start, found.end, None, _page(h.get("warc-record-id")), kind, h.get("warc-target-uri"),
        _page(h.get("warc-refers-to")), size, digest, payload if with_payload and kind == "response" else None,
    )


def _reader(with_payload: bool):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path in files.column("path").to_pylist():
                system, name = pa.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_file(name) as stream:
                    for found in salvage(stream):
                        rows.append(_row(path, found, with_payload))
                        size += 256 + len(rows[-1][-1] or b"")
                        if size > (4 << 20):
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives listed in ``path``; rows with ``gap`` are quarantined byte ranges."""
    return files.select("path").mapInArrow(_reader(payload), ROW)


SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), w AS (SELECT payload_digest, max(page_id) AS stays FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN stays IS NOT NULL AND page_id IS DISTINCT FROM stays THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM stays THEN stays END AS refers_to, NULL::VARCHAR AS gap
FROM p LEFT JOIN w USING (payload_digest)
"""


@query("op5_warc", SQL)
def op5(spark, sf_dir) -> DataFrame:
    folder = new_path(spark, "warc")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    files = manifest.repartition(4 * spark.sparkContext.defaultParallelism)
    records = read_archives(files, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap")
