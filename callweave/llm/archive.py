"""Operator 3: legacy web archives (ARC, versions 1 and 2) converted to WARC 1.1, and both read back.

``write_arc`` writes pages to ARC files as HTTP responses, one file a partition; even partitions use version 1 of the
format, odd ones version 2. ``arc_records`` parses such files: the version block names the version and the fields of the
header lines, a record's header line declares its length, and the body of that length follows. ``plan_revisits`` finds
records of equal payloads. ``write_warc`` streams each ARC file once more and writes the equivalent WARC file: record ids
derived from the record's own data, timestamps, types and digests. ``read_warc`` reads WARC files back.

Payloads never pass through a shuffle; only digests, lengths and ids do. Files are gzipped record by record, written
under another name and moved, so that a repeated task replaces a file by an equal one.

Nulls and ties: a null html counts as empty; a null url becomes ``urn:page:<id>``; white space in a url, which header
lines cannot hold, is percent-encoded; rows that are equal have record ids of their own; of equal payloads of at least
``least`` bytes the record with the largest id is the response; rows that repeat an id count as one page each, the
response being the one that comes first in the files; an empty table writes no file; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import one_task_each, rows_to_batches, written
from callweave.llm.stream_file import place

# Fixed values of the two archive formats.
ARC_V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "file long, path string, records long"
_FILES = pa.schema([("file", pa.int64()), ("path", pa.string()), ("records", pa.int64())])
_INDEX = pa.schema([("file", pa.int64()), ("path", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
_WARC = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("uri", pa.string()), ("date", pa.string())])
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:callweave:arc-record")
PAGE_HEADER = "X-Page-Id"


def packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def http_response(page_id: int | None, html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {'' if page_id is None else page_id}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


class Moved:
    """A file written under a task's own name, moved to its place at the end."""

    def __init__(self, uri: str):
        self.filesystem, self.path = place(uri)
        self.attempt = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.filesystem.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.filesystem.open_output_stream(self.attempt)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.filesystem.move(self.attempt, self.path)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` to ARC files under ``folder``; returns a row for each file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, records, out = TaskContext.get().partitionId(), 0, None
        second = number % 2 == 1
        uri = f"{folder}/pages-{number:06d}.arc.gz"
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = Moved(uri)
                    about = f"{2 if second else 1} 0 callweave\n{ARC_V2_FIELDS if second else ARC_V1_FIELDS}\n\n"
                    more = f"200 - - 0 pages-{number:06d} " if second else ""
                    out.write(packed(f"filedesc://pages-{number:06d}.arc 0.0.0.0 20240101000000 text/plain {more}{len(about)}\n{about}".encode()))
                body = http_response(page_id, (html or "").encode())
                name = re.sub(r"\s", lambda m: quote(m[0]), url) if url else f"urn:page:{page_id}"
                more = f"200 {zlib.crc32(body):08x} - {records} pages-{number:06d} " if second else ""
                out.write(packed(f"{name} 0.0.0.0 20240101000000 text/html {more}{len(body)}\n".encode() + body + b"\n"))
                records += 1
        if out is not None:
            out.close()
            yield from rows_to_batches([(number, uri, records)], _FILES)

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return written(rows.mapInArrow(task, FILES), "arc-files")


class Source:
    """The unpacked bytes of a gzipped file, read in pieces."""

    def __init__(self, uri: str, piece: int = 1 << 20):
        filesystem, path = place(uri)
        self.file, self.piece, self.have, self.left = filesystem.open_input_stream(path, compression=None), piece, b"", b""
        self.open = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.open.eof:
            rest = self.open.unused_data or self.left
            self.open, self.left = zlib.decompressobj(31), b""
        else:
            rest = b""
        rest = rest or self.file.read(self.piece)
        if not rest:
            return False
        self.have += self.open.decompress(rest)
        return True

    def line(self) -> bytes | None:
        while (end := self.have.find(b"\n")) < 0:
            if not self._more():
                return None
        found, self.have = self.have[:end], self.have[end + 1 :]
        return found

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise ValueError("the record is shorter than its declared length")
        found, self.have = self.have[:n], self.have[n:]
        return found


def arc_file(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file: header fields by their declared names, and body."""
    source = Source(uri)
    first = source.line()
    if first is None or not first.startswith(b"filedesc://"):
        raise ValueError(f"{uri} has no version block")
    block = source.take(int(first.rsplit(b" ", 1)[1])).decode().split("\n")
    version = int(block[0].split(" ")[0])
    fields = block[1].split(" ")
    if version not in (1, 2) or fields[-1] != "Archive-length":
        raise ValueError(f"{uri}: unknown version block {block[:2]}")
    while (line := source.line()) is not None:
        if not line:
            continue
        values = line.decode().rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{uri}: a header line has {len(values)} of {len(fields)} fields")
        header = dict(zip(fields, values))
        yield header, source.take(int(header["Archive-length"]))


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the head's bytes, the payload."""
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + b"\r\n\r\n", payload


def record_id(header: dict[str, str], page: str, digest: str, file: int, ordinal: int) -> str:
    """Unique for each record: equal records differ in their place."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join([header['URL'], header['Archive-date'], page, digest, str(file), str(ordinal)]))}"


def warc_date(archive_date: str) -> str:
    d = archive_date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_records(files: DataFrame) -> DataFrame:
    """An index row for each record of the ARC files: place, page id, record id to be, payload's bytes and SHA-1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for number, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, (header, body) in enumerate(arc_file(uri)):
                        about, _, payload = split_http(body)
                        page = about.get(PAGE_HEADER.lower(), "")
                        digest = hashlib.sha1(payload).hexdigest()
                        yield number, uri, k, int(page) if page else None, record_id(header, page, digest, number, k), header["URL"], warc_date(header["Archive-date"]), len(payload), digest

        yield from rows_to_batches(rows(), _INDEX)

    return one_task_each(files.select("file", "path"), "file").mapInArrow(task, "file long, path string, ordinal long, page_id long, record_id string, uri string, date string, payload_bytes long, digest string")


def plan_revisits(index: DataFrame, least: int = 1000) -> DataFrame:
    """``index`` with the id, record, uri and date that a revisit refers to, null for responses. A record of ``least`` bytes or more revisits the
    record of an equal payload that has the largest page id. Counts are aggregated before the shuffle; a payload that
    very many records share makes a skewed join with one row on the other side, which Spark splits."""
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 62))), -F.col("file"), -F.col("ordinal"))
    groups = index.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max_by(F.struct("page_id", "record_id", "uri", "date", "file", "ordinal"), order).alias("best"))
    joined = index.join(groups.where("n > 1").select("digest", "best"), "digest", "left")
    revisit = F.col("best").isNotNull() & ~((F.col("best.file") == F.col("file")) & (F.col("best.ordinal") == F.col("ordinal")))
    first = {"refers_to": "page_id", "refers_to_record": "record_id", "refers_to_uri": "uri", "refers_to_date": "date"}
    return joined.select(*index.columns, *[F.when(revisit, F.col(f"best.{c}")).alias(name) for name, c in first.items()])


def warc_record(header: dict[str, str], body: bytes, digest: str, ident: str, refers_to: int | None, refers_record: str | None, refers_uri: str | None, refers_date: str | None) -> bytes:
    about, head, payload = split_http(body)
    block = head if refers_record else body
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_record else 'response'}", f"WARC-Record-ID: <{ident}>", f"WARC-Target-URI: {header['URL']}",
        f"WARC-Date: {warc_date(header['Archive-date'])}", f"WARC-IP-Address: {header['IP-address']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_record:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_record}>", f"WARC-Refers-To-Target-URI: {refers_uri}", f"WARC-Refers-To-Date: {refers_date}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(plan: DataFrame, folder: str) -> DataFrame:
    """Streams each ARC file of ``plan`` and writes the WARC file beside it; a row for each file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, out, source, number, count, at = [], None, None, None, 0, 0, 0

        def end() -> None:
            if out is not None:
                out.close()
                made.append((number, uri, count))

        uri = ""
        for batch in batches:
            for file, path, ordinal, ident, digest, *refers in zip(*(c.to_pylist() for c in batch.columns)):
                if path != now:
                    end()
                    now, number, count, at, source = path, file, 0, 0, arc_file(path)
                    uri = f"{folder}/pages-{file:06d}.warc.gz"
                    out = Moved(uri)
                    about = f"software: callweave\r\nformat: WARC File Format 1.1\r\nsource: pages-{file:06d}.arc\r\n".encode()
                    out.write(packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, uri.rsplit('/', 1)[1])}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about + b"\r\n\r\n"))
                while at <= ordinal:
                    header, body = next(source)
                    at += 1
                out.write(packed(warc_record(header, body, digest, ident, *refers)))
                count += 1
        end()
        yield from rows_to_batches(made, _FILES)

    rows = plan.select("file", "path", "ordinal", "record_id", "digest", "refers_to", "refers_to_record", "refers_to_uri", "refers_to_date")
    return written(rows.repartition("path").sortWithinPartitions("path", "ordinal").mapInArrow(task, FILES), "warc-files")


def warc_file(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    source = Source(uri)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{uri}: not a WARC record: {line[:40]!r}")
        header = {}
        while line := (source.line() or b"").rstrip(b"\r"):
            name, _, value = line.decode().partition(":")
            header[name.lower()] = value.strip()
        yield header, source.take(int(header["content-length"]))


def read_warc(files: DataFrame) -> DataFrame:
    """A row for each response or revisit record of the WARC files. A response's digest is computed from its payload and
    must equal the declared one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(1).to_pylist():
                    for header, block in warc_file(uri):
                        if header["warc-type"] not in ("response", "revisit"):
                            continue
                        about, _, payload = split_http(block)
                        digest = base64.b32decode(header["warc-payload-digest"].partition(":")[2]).hex()
                        if header["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{uri}: {header['warc-record-id']} has another payload than declared")
                        size = len(payload) if header["warc-type"] == "response" else int(about["content-length"])
                        page, other = about.get(PAGE_HEADER.lower(), ""), header.get("x-refers-to-page", "")
                        yield int(page) if page else None, size, digest, header["warc-type"], int(other) if other else None, header["warc-record-id"].strip("<>"), header.get("warc-refers-to", "").strip("<>") or None, header["warc-target-uri"], header["warc-date"]

        yield from rows_to_batches(rows(), _WARC)

    return one_task_each(files.select("file", "path"), "file").mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, uri string, date string")


def convert(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Pages → ARC files → WARC files under ``folder``; a row for each WARC record read back."""
    files = write_arc(pages, f"{folder}/arc")
    return read_warc(write_warc(plan_revisits(arc_records(files), least), f"{folder}/warc"))
