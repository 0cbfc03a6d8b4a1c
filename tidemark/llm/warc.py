"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.ship import ship

from .common import cut, join_groups

#: A file is closed when it has so many bytes.
FILE_BYTES = 48 << 20
#: Bytes that are read at first in search of the end of a record's headers; four times as many, and so on, where it isn't in them.
HEADER_BYTES = 1 << 16
#: How a gzip member and a record's version line begin.
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HEADERS_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record. A revisit has the HTTP headers of what it revisits, length included, and no
    payload (the identical-payload-digest profile)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write(
    df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, compress: bool = True, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record for every row into ``folder``, a shared place by URI; returns (path, bytes,
    records) of the files.

    Of rows whose payloads are equal and have ``least`` bytes or more, that with the smallest id is
    a response and the others revisit it; all others are responses. Null html is an empty payload,
    a null id is written as null (a response, if no row with an id has the payload), a null url has
    no target; rows repeated with one id and payload are each a response; no rows make no files.
    Every attempt of a task writes files of its own names; only those that the returned table, which
    is written once, names are ever read, so lost executors leave nothing half-read.
    """
    ship(df.sparkSession)
    rows = df.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.encode(F.col(f"`{html}`"), "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    large = rows.filter(F.length("payload") >= least)
    first = cut(large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1 and first is not null"), "first")
    joined = join_groups(rows, first, ["sha"], ["page_id", "url"], how="left").drop("sha", "times").withColumn("first", F.when(F.length("payload") >= least, F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, uri, payload, to = row
                revisit = to is not None and to != key
                data = record(
                    "revisit" if revisit else "response", f"urn:page:{'null' if key is None else key}", uri.replace("\r", "%0D").replace("\n", "%0A"), date, payload, f"urn:page:{to}" if revisit else None
                )
                data = member(data) if compress else data
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    out, size, n = fs.open_output_stream(name, compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        names = [f"{folder.rstrip('/')}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return cut(joined.select("page_id", "url", "payload", "first").mapInArrow(run, "path string, bytes long, records long"), "files")


class Bad(Exception):
    """What is at a place isn't a whole record."""


class Window:
    """Bytes of a file by place; holds a moving part of it."""

    STEP = 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.STEP))
        return self.held[at - self.at : at - self.at + n]

    def find(self, at: int) -> int:
        """Place of the next sign of a member or record from ``at`` on; the file's end, if none."""
        while at < self.size:
            part = self.get(at, self.STEP)
            if m := _START.search(part):
                return at + m.start()
            at += max(1, len(part) - 6) if at + len(part) < self.size else len(part)
        return self.size


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers by lower-case name, block, end) of the record at ``start``; Bad if any check fails:
    the version line, the headers' end, the length, the two newlines after it, the block's digest."""
    if not _VERSION_LINE.match(data, start):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise Bad("headers don't end")
    head: dict[str, str] = {}
    for line in data[start:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header has no colon")
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Bad("no length")
    at = end + 4
    stop = at + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("the block doesn't end where its length says")
    block = data[at:stop]
    if (digest := head.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Bad("the block's digest differs")
    return head, block, stop + 4


def _member_at(w: Window, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; Bad if it is damaged, checksum included."""
    unpack, parts, here = zlib.decompressobj(31), [], at
    while not unpack.eof:
        part = w.get(here, 1 << 16)
        if not part:
            raise Bad("the member is cut short")
        try:
            parts.append(unpack.decompress(part))
        except zlib.error as e:
            raise Bad(str(e)) from None
        here += len(part)
    return b"".join(parts), here - len(unpack.unused_data)


def _headers_at(w: Window, at: int) -> bytes:
    """A record's headers with the blank line that ends them. The next version line ends the search,
    as no header holds one, so looking through damaged parts stays linear."""
    n = HEADER_BYTES
    while True:
        part = w.get(at, n)
        if m := _HEADERS_END.search(part):
            if m[0] != b"\r\n\r\n":
                raise Bad("headers don't end")
            return part[: m.end()]
        if len(part) < n:
            raise Bad("headers don't end")
        n *= 4


def _record_at(w: Window, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    start = w.get(at, 7)
    if start.startswith(MEMBER):
        data, end = _member_at(w, at)
        out, here = [], 0
        while here < len(data):
            head, block, here = parse(data, here)
            out.append((head, block))
        if not out:
            raise Bad("an empty member")
        return out, end
    if start != VERSION:
        raise Bad("neither a member nor a version line")
    head = _headers_at(w, at)
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head[: max(head.find(b"\r\n\r\n"), 0)])
    if not m:
        raise Bad("no length")
    need = head.find(b"\r\n\r\n") + 8 + int(m[1])
    if at + need > w.size:
        raise Bad("the record is cut short")
    h, block, end = parse(w.get(at, need))
    return [(h, block)], at + end


def salvage(file, size: int) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """(kind, offset, length, headers, block, reason) of a file in order: kind is ``record``, or
    ``gap`` for bytes that no valid record covers.

    Where a check fails, the next member or version line is sought and tried, and so on until one
    holds; the bytes between are one gap, with the first failure as its reason.
    """
    w, at = Window(file, size), 0
    while at < size:
        try:
            records, end = _record_at(w, at)
        except Bad as e:
            gap, reason = at, str(e)
            at = w.find(at + 1)
            while at < size:
                try:
                    records, end = _record_at(w, at)
                    break
                except Bad:
                    at = w.find(at + 1)
            yield "gap", gap, at - gap, {}, b"", reason
            if at >= size:
                return
        for head, block in records:
            yield "record", at, end - at, head, block, ""
        at = end


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """(the length its HTTP headers give, payload) of a block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    return (int(m[1]) if m else None), payload


FIELDS = "path string, kind string, offset long, length long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string"


def read(files: DataFrame) -> DataFrame:
    """Records and gaps of the archives that ``files`` (path) names, gzip members or plain.

    Each file is read by one task, record by record, through the file system that its URI names.
    payload_digest is worked out from the payload of a response, and taken from the header of a
    revisit; payload_bytes of a revisit is the length in the HTTP headers it has. A gap has its
    place, length and reason, and nothing else. Empty files give no rows; null paths are passed over.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(files.sparkSession)
    schema = StructType.fromDDL(FIELDS)
    arrow = to_arrow_schema(schema)
    paths = files.select("path").filter("path is not null")
    n = max(1, min(10_000, paths.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_file(inner) as f:
                    for kind, offset, length, head, block, reason in salvage(f, f.size()):
                        row = {"path": path, "kind": kind, "offset": offset, "length": length, "reason": reason or None}
                        if kind == "record":
                            bare = lambda v: v.strip("<>") if v is not None else None
                            stated, payload = split_http(block)
                            revisit = head.get("warc-type") == "revisit"
                            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload)
                            row |= {"record_type": head.get("warc-type"), "record_id": bare(head.get("warc-record-id")), "uri": head.get("warc-target-uri"), "refers_to": bare(head.get("warc-refers-to"))}
                            row |= {"payload_digest": digest, "payload_bytes": stated if revisit else len(payload), "payload": None if revisit else payload}
                        rows.append(row)
                        size += len(block) + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return paths.repartition(n).mapInArrow(run, schema)


def pages(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives' pages."""
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    own = records.filter("kind = 'record' and record_type in ('response', 'revisit')")
    return own.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
