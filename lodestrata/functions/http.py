"""HTTP messages in archive records: header split, transfer and content decoding, and what a capture takes from them."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

MAX_OUT = 128 << 20
_LINE_LIMIT = 64


@dataclass
class Parts:
    status: int | None
    content_type: str | None
    content_encoding: str | None
    location: str | None
    body: bytes


def status_of(block: bytes) -> int | None:
    """The second word of the first line, if it is a number of 16 bits."""
    words = block.split(b"\n", 1)[0].split()
    if len(words) > 1 and words[1].isdigit() and int(words[1]) < 65536:
        return int(words[1])
    return None


def content_type_of(block: bytes) -> str | None:
    """The first content type that isn't empty, before the blank line; None if the header isn't UTF-8."""
    head = block.partition(b"\r\n\r\n")[0]
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        return None
    for line in text.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-type" and value.strip():
            return value.strip()
    return None


def parse_block(block: bytes) -> Parts:
    """Header and body; without a blank line all is body. Of repeated headers the last counts."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return Parts(None, None, None, None, block)
    values: dict[str, str] = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            values[name.strip().lower()] = value.strip()
    encoding = values.get("content-encoding")
    return Parts(status_of(block), values.get("content-type"), encoding.lower() if encoding is not None else None, values.get("location"), body)


def dechunk(body: bytes) -> bytes | None:
    """The joined chunks if the whole body is a sequence of chunks, else None. A cut-off last chunk keeps what is there."""
    out, at = [], 0
    if not re.match(rb"[0-9A-Fa-f]", body):
        return None
    while at < len(body):
        end = body.find(b"\r\n", at, at + _LINE_LIMIT + 2)
        if end < 0:
            return None
        m = re.fullmatch(rb"([0-9A-Fa-f]{1,16})[ \t]*(?:;.*)?", body[at:end])
        if not m:
            return None
        size = int(m[1], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        if at >= len(body):
            return b"".join(out)
        if body[at : at + 2] != b"\r\n":
            return b"".join(out) if body[at:] == b"\r" else None
        at += 2
    return b"".join(out)


def _inflate(data: bytes, bits: int, limit: int) -> bytes | None:
    """As much as can be inflated; None if nothing can."""
    d = zlib.decompressobj(bits)
    out, ok = [], False
    size = 0
    try:
        for at in range(0, len(data), 65536):
            part = d.decompress(data[at : at + 65536], max(1, limit - size))
            ok = True
            out.append(part)
            size += len(part)
            if size >= limit or d.eof:
                break
        out.append(d.flush() if size < limit else b"")
        return b"".join(out)[:limit]
    except zlib.error:
        return b"".join(out)[:limit] if ok and size else None


class Undecodable(ValueError):
    """A body in an encoding that can't be undone."""


def payload(parts: Parts, limit: int = MAX_OUT) -> bytes:
    """The body without chunks and content encoding. A body that lies about its encoding is taken as stored, unless it is
    binary; partial output is kept."""
    body = dechunk(parts.body)
    body = parts.body if body is None else body
    encoding = (parts.content_encoding or "").strip()
    if encoding in ("", "identity", "none"):
        return body[:limit]
    if encoding in ("gzip", "x-gzip"):
        out = _inflate(body, 31, limit)
    elif encoding == "deflate":
        out = _inflate(body, 15, limit)
        out = _inflate(body, -15, limit) if out is None else out
    else:
        raise Undecodable(encoding)
    if out is None:
        if b"\0" in body[:1024]:
            raise Undecodable(encoding)
        return body[:limit]
    return out


def wire_class(parts: Parts, is_pdf: bool) -> str:
    """encoded: text would be damaged if taken as stored; chunked: only in chunks; none."""
    chunked = dechunk(parts.body) is not None
    if (parts.content_encoding or "") not in ("", "identity", "none") or (chunked and is_pdf):
        return "encoded"
    return "chunked" if chunked else "none"


PARTS = StructType(
    [
        StructField("status", IntegerType()), StructField("content_type", StringType()), StructField("content_encoding", StringType()),
        StructField("location", StringType()), StructField("chunked", BooleanType()), StructField("payload", BinaryType()), StructField("error", StringType()),
    ]
)


@F.pandas_udf(PARTS)
def http_parts(block: pd.Series) -> pd.DataFrame:
    """Status, headers and decoded payload of response blocks; an undecodable payload is null with the reason."""
    rows = []
    for b in block:
        if b is None:
            rows.append((None,) * 7)
            continue
        p = parse_block(bytes(b))
        try:
            body, error = payload(p), None
        except Undecodable as e:
            body, error = None, f"undecodable: {e}"
        rows.append((p.status, p.content_type, p.content_encoding, p.location, dechunk(p.body) is not None, body, error))
    out = pd.DataFrame(rows, columns=[f.name for f in PARTS])
    out["status"] = out["status"].astype("Int32")
    return out
