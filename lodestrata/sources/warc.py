"""WARC files, plain or with one gzip member for each record, as a Python data source; and a writer.

``spark.read.format("warc").load(path)`` gives one row for each record; each file is a partition's work. Options: ``path``
(a file, a folder, or a glob), ``mode`` (``PERMISSIVE`` gives a row with ``error`` for what can't be read, ``FAILFAST``
raises). In gzip files a bad member is passed over; elsewhere the first error ends the file, as what follows can't be
told apart. ``offset`` is the record's true start in the plain bytes, ``c_offset`` its member's in the file.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "s3_key string, offset bigint, c_offset bigint, version string, record_type string, record_id string, warc_date string, target_uri string, content_type string, content_length bigint, "
    "refers_to string, block_digest string, payload_digest string, truncated string, warcinfo_id string, concurrent_to array<string>, ip_address string, identified_payload_type string, "
    "headers array<struct<name:string,value:string>>, block binary, error string"
)
MAX_HEADER = 64 << 10
MAX_BLOCK = 1 << 30
_version = re.compile(rb"WARC/(\d+)\.(\d+)\s*$")


class WarcError(ValueError):
    """A record that can't be read."""


class _Source:
    """Bytes with their place."""

    def __init__(self, raw: io.BufferedIOBase):
        self.raw, self.at = raw, 0

    def line(self, limit: int) -> bytes:
        got = self.raw.readline(limit)
        self.at += len(got)
        return got

    def read(self, n: int) -> bytes:
        got = self.raw.read(n)
        self.at += len(got)
        return got


def read_record(src: _Source) -> tuple[int, str, list[tuple[str, str]], bytes] | None:
    """(start, version, headers, block), None at the end. Blank lines between records are passed over; a folded header line
    is joined with one space; names are in lower case."""
    while True:
        start = src.at
        line = src.line(MAX_HEADER)
        if not line:
            return None
        if line.strip(b"\r\n"):
            break
    m = _version.match(line)
    if not m:
        raise WarcError(f"no version line at {start}: {line[:40]!r}")
    headers: list[list[str]] = []
    size = len(line)
    while True:
        line = src.line(MAX_HEADER)
        size += len(line)
        if not line.endswith(b"\n"):
            raise WarcError("the header is cut off")
        if size > MAX_HEADER:
            raise WarcError("the header is too long")
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t":
            if not headers:
                raise WarcError("a folded line without a header")
            headers[-1][1] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise WarcError(f"no colon in {text[:40]!r}")
        headers.append([name.strip().lower(), value.strip()])
    own = {k: v for k, v in headers}
    if not own.get("content-length", "").isdigit() or int(own["content-length"]) > MAX_BLOCK:
        raise WarcError("no valid Content-Length")
    block = src.read(int(own["content-length"]))
    if len(block) < int(own["content-length"]):
        raise WarcError("the block is cut off")
    if src.read(4) != b"\r\n\r\n":
        raise WarcError("the record isn't closed by two line ends")
    return start, f"{int(m[1])}.{int(m[2])}", [(k, v) for k, v in headers], block


def members(raw: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    """(start, plain bytes) of each gzip member; raises zlib.error or WarcError where they end in disorder."""
    start, rest = 0, b""
    while True:
        while len(rest) < 2 and (more := raw.read(1 << 16)):
            rest += more
        if not rest.strip(b"\0"):
            return
        if rest[:2] != b"\x1f\x8b":
            raise WarcError(f"no gzip member at {start}")
        d = zlib.decompressobj(31)
        out, used = [], 0
        while not d.eof:
            if not rest:
                rest = raw.read(1 << 16)
                if not rest:
                    raise WarcError(f"the member at {start} is cut off")
            out.append(d.decompress(rest))
            used += len(rest) - len(d.unused_data)
            rest = d.unused_data
        yield start, b"".join(out)
        start += used


def _row(key: str, offset: int | None, c_offset: int | None, version: str, headers: list[tuple[str, str]], block: bytes) -> tuple:
    own = dict(headers)
    kind = own.get("warc-type")
    return (
        key, offset, c_offset, version, kind.lower() if kind else None, own.get("warc-record-id"), own.get("warc-date"), (own.get("warc-target-uri") or "").strip("<>") or None,
        own.get("content-type"), len(block), own.get("warc-refers-to"), own.get("warc-block-digest"), own.get("warc-payload-digest"), own.get("warc-truncated"), own.get("warc-warcinfo-id"),
        [v for k, v in headers if k == "warc-concurrent-to"] or None, own.get("warc-ip-address"), own.get("warc-identified-payload-type"), headers, block, None,
    )


def read_file(path: str, key: str, permissive: bool = True) -> Iterator[tuple]:
    """The rows of one file."""
    bad = lambda place, c, e: (key, place, c, *[None] * 17, str(e))
    with open(path, "rb") as raw:
        gz = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        if not gz:
            src = _Source(raw)
            try:
                while (got := read_record(src)) is not None:
                    yield _row(key, got[0], None, *got[1:])
            except WarcError as e:
                if not permissive:
                    raise
                yield bad(src.at, None, e)
            return
        plain, found = 0, members(raw)
        while True:
            try:
                start, data = next(found)
            except StopIteration:
                return
            except (WarcError, zlib.error) as e:
                if not permissive:
                    raise
                yield bad(plain, None, e)
                return
            try:
                got = read_record(_Source(io.BytesIO(data)))  # only the first record of a member
                if got is not None:
                    yield _row(key, plain + got[0], start, *got[1:])
            except WarcError as e:
                if not permissive:
                    raise
                yield bad(plain, start, e)
            plain += len(data)


def read_at(path: str, offset: int, c_offset: int | None) -> bytes:
    """The block of one record by its place: a gzip member from c_offset, else plain bytes from offset."""
    with open(path, "rb") as raw:
        gz = raw.read(2) == b"\x1f\x8b"
        if gz and c_offset is None:
            raise WarcError("no compressed offset")
        raw.seek(c_offset if gz else offset)
        if not gz:
            got = read_record(_Source(raw))
        else:
            got = read_record(_Source(io.BytesIO(next(members(raw))[1])))
    if got is None:
        raise WarcError("no record there")
    return got[3]


class _File(InputPartition):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.permissive = options.get("mode", "PERMISSIVE").upper() != "FAILFAST"

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        if os.path.isdir(path):
            found = [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if re.search(r"(?i)\.warc(\.gz)?$", f)]
            return [_File(f, os.path.relpath(f, path)) for f in sorted(found)]
        return [_File(f, os.path.basename(f)) for f in sorted(glob.glob(path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        return read_file(partition.path, partition.key, self.permissive)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(WarcSource)


def record_bytes(record_type: str, headers: list[tuple[str, str]], block: bytes, version: str = "1.1") -> bytes:
    lines = [f"WARC/{version}", f"WARC-Type: {record_type}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_file(path: str, records: list[bytes], gz: bool = True) -> list[tuple[int, int | None]]:
    """Records into one file, each a gzip member of its own if ``gz``; their offsets and compressed offsets."""
    out, plain = [], 0
    with open(path, "wb") as f:
        for r in records:
            out.append((plain, f.tell() if gz else None))
            if gz:
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                f.write(c.compress(r) + c.flush())
            else:
                f.write(r)
            plain += len(r)
    return out


def recompress(source: str, target: str, salvage: bool = False) -> dict:
    """Rewrite a file with one member for each record, whatever its form; the plain bytes must come out the same. With
    ``salvage`` a cut-off tail is dropped. Gives the outcome, the records and the bytes."""
    with open(source, "rb") as f:
        data = f.read()
    if data[:2] == b"\x1f\x8b":
        plain, form = [], 0
        try:
            for _, part in members(io.BytesIO(data)):
                plain.append(part)
                form += 1
        except (WarcError, zlib.error) as e:
            if not salvage:
                return {"outcome": "failed", "reason": str(e), "records": 0, "bytes": 0}
        whole = b"".join(plain)
    else:
        whole, form = data, 0
    src, cuts = _Source(io.BytesIO(whole)), []
    try:
        while (got := read_record(src)) is not None:
            cuts.append((got[0], src.at))
    except WarcError as e:
        if not salvage:
            return {"outcome": "failed", "reason": str(e), "records": len(cuts), "bytes": 0}
    if form and form == len(cuts):
        return {"outcome": "per-record already", "reason": None, "records": len(cuts), "bytes": len(data)}
    write_file(target, [whole[a:b] for a, b in cuts])
    with open(target, "rb") as f:
        again = b"".join(part for _, part in members(f))
    if again != b"".join(whole[a:b] for a, b in cuts):
        os.unlink(target)
        return {"outcome": "failed", "reason": "the copy differs", "records": 0, "bytes": 0}
    return {"outcome": "rewritten", "reason": None, "records": len(cuts), "bytes": len(whole)}
