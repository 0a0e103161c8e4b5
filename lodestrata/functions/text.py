"""Text from HTML, plain text and PDF: tags, entities, white space, titles, and the quality gate."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestrata.functions.urls import is_pdf_path, resolve

#: Comments, whole script, style and noscript elements, and tags, in one pass from left to right.
MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript)[>/ \t\r\n].*?(?:</\1[^>]*(?:>|\z)|\z)|<[^>]*(?:>|\z)"
_entity = re.compile(r"&(?:(amp|lt|gt|quot|apos|nbsp)|#([0-9]{1,9})|#[xX]([0-9a-fA-F]{1,8}));")
_named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, MARKUP, " ")


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def decode_entities(text: str | None) -> str | None:
    """One pass over the few named and all numeric references; others, and longer than 12 characters, stay."""
    if text is None:
        return None

    def one(m: re.Match) -> str:
        if len(m[0]) > 12:
            return m[0]
        if m[1]:
            return _named[m[1]]
        n = int(m[2]) if m[2] else int(m[3], 16)
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _entity.sub(one, text)


@F.pandas_udf(StringType())
def entities(text: pd.Series) -> pd.Series:
    return text.map(decode_entities)


def named_entities(text: Column) -> Column:
    """Without Python, for texts with named references only."""
    for name, char in _named.items():
        if name != "amp":
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def decoded(text: Column) -> Column:
    """Entities decoded; Python is asked only where numeric references stand."""
    return F.when(text.contains("&#"), entities(text)).otherwise(named_entities(text))


def strip_html(html: Column) -> Column:
    return collapse_space(decoded(strip_tags(html)))


def html_title(html: Column) -> Column:
    """The first title element, 512 characters at most; empty if there is none."""
    return F.substring(collapse_space(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))), 1, 512)


def utf8_lossy(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut before a character that doesn't fit."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.regexp_replace(cut, "�+$", ""))


def plain_title(text: Column) -> Column:
    return F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, 256)


def plain_body(text: Column) -> Column:
    """What follows the first line."""
    return F.when(text.contains("\n"), F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")


#: Long s and the ligatures of old print (fixed values).
HISTORIC = (("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def historic_forms(text: Column) -> Column:
    for old, new in HISTORIC:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_page_space(text: Column) -> Column:
    """By page: lines trimmed, runs of spaces to one, at most one blank line in a row."""
    page = lambda p: F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.split(p, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.array_join(F.transform(F.split(text, "\f"), page), "\f")


def looks_like_text(text: Column) -> Column:
    """At least 40 characters besides space, 55 % of them letters or digits, and 40 % of the tokens words: two letters or
    more that make up half of the token."""
    solid = F.regexp_replace(text, r"(?U)\s+", "")
    alnum = F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")
    tokens = F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda t: t != "")
    letters = lambda t: F.length(F.regexp_replace(t, r"\P{L}", ""))
    words = F.filter(tokens, lambda t: (letters(t) >= 2) & (letters(t) * 2 >= F.length(t)))
    ok = (F.length(solid) >= 40) & (F.length(alnum) >= 0.55 * F.length(solid)) & (F.size(words) >= 0.4 * F.size(tokens))
    return F.coalesce(ok, F.lit(False))


def title_from_url(url: Column) -> Column:
    """The last part of the path that isn't empty, without .pdf, with spaces for ``_``, ``+`` and ``%20``."""
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/*$", 1)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(path, r"\.(?:pdf|PDF)$", ""), r"_|\+|%20", " ")), 1, 256)


def pdf_has_eof(data: Column) -> Column:
    """Whether the end mark stands in the last 4096 bytes."""
    tail = F.expr("cast(null as binary)") if data is None else F.substring(data, F.greatest(F.octet_length(data) - 4095, F.lit(1)), F.lit(4096))
    return F.instr(F.hex(tail), "2525454F46") > 0


_skipped = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript)[>/ \t\r\n].*?(?:</\1[^>]*(?:>|\Z)|\Z)")
_tag = re.compile(r"(?s)<[a-zA-Z][^>]*(?:>|\Z)")
_href = re.compile(r"(?is)[ \t\r\n\f]href[ \t\r\n\f]*=[ \t\r\n\f]*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+))")


def links_of(base: str | None, html: str | None, pdf_only: bool = False) -> list[str]:
    """The absolute http(s) targets of all href attributes, one entry for each occurrence."""
    if not base or not html or not base.lower().startswith(("http://", "https://")):
        return []
    out = []
    for tag in _tag.finditer(_skipped.sub(" ", html)):
        for m in _href.finditer(tag[0]):
            link = resolve(base, decode_entities(m[1] or m[2] or m[3] or "") or "")
            if link and (not pdf_only or is_pdf_path(link)):
                out.append(link)
    return out


@F.pandas_udf(ArrayType(StringType()))
def links(base: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([links_of(b, h) for b, h in zip(base, html, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def pdf_links(base: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([links_of(b, h, True) for b, h in zip(base, html, strict=True)])


_block = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|table|tr|h[1-6]|blockquote|pre)\b[^>]*>")


def xhtml_to_text(xhtml: str | None) -> str | None:
    """The pages of an extractor's XHTML, parted by form feeds; a blank page keeps its place."""
    if xhtml is None:
        return None
    pages = re.split(r'(?i)<div\s+class="page"[^>]*>', xhtml)
    pages = pages[1:] if len(pages) > 1 else pages
    out = []
    for page in pages:
        text = _html.unescape(re.sub(r"(?s)<[^>]*>", "", _block.sub("\n", _skipped.sub(" ", page))))
        lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
        out.append(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n"))
    return "\f".join(out)


def parse_rmeta(text: str | None) -> tuple[str | None, str]:
    """(title, text) of an extractor's JSON: the first title, all contents."""
    title, out = None, []
    for part in json.loads(text or "[]"):
        t = part.get("dc:title")
        title = title or (t[0] if isinstance(t, list) else t)
        if content := part.get("X-TIKA:content"):
            out.append((xhtml_to_text(content) or "") + "\n")
    return title, "".join(out)


@F.pandas_udf(StringType())
def xhtml_text(xhtml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in xhtml:
        yield part.map(xhtml_to_text)


def register(spark) -> None:
    """The Python functions by name, for SQL."""
    for name, f in {"decode_entities": entities, "html_links": links, "pdf_links": pdf_links, "xhtml_text": xhtml_text}.items():
        spark.udf.register(name, f)
