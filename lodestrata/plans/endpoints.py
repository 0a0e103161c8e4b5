"""What the endpoints answer, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.functions import timestamps as ts
from lodestrata.functions.skiplist import SkipList
from lodestrata.operators import captures as cp
from lodestrata.operators import fulltext as ft
from lodestrata.operators import statistics as st


class BadRequest(ValueError):
    """Parameters that can't be used."""


def lookup_capture(captures: DataFrame, surt: str, at: str | None = None) -> DataFrame:
    """The newest capture, or the one closest to a time of 4 to 14 digits, filled up to its earliest instant."""
    if at is None:
        return captures.filter(F.col("surt_url") == surt).orderBy(F.desc("timestamp"), F.desc("s3_key"), F.desc("offset")).limit(1)
    if not at.isdigit():
        raise BadRequest("a timestamp has digits only")
    fill = "00010101000000"
    return cp.closest(captures, surt, (at + fill[len(at) :])[:14])


def capture_text(rows: DataFrame) -> DataFrame:
    """(original, text, ok) of captures with their payload: HTML stripped, any other text as it is, first line included; other
    types give null. ``ok`` tells whether it looks like text."""
    mime, raw = F.coalesce("mime", F.lit("")), tx.utf8_lossy(F.col("payload"))
    text = F.when(mime.startswith("text/html") | mime.startswith("application/xhtml"), tx.strip_html(raw)).when(mime.startswith("text/"), raw)
    return rows.select("original", text.alias("text")).withColumn("ok", tx.looks_like_text(F.col("text")))


def search(index: ft.Index, params: dict, skip: SkipList | None = None, max_results: int = 50) -> DataFrame:
    """q, limit (500 at most), collection, from, to; bounds that can't be read are ignored."""
    limit = params.get("limit")
    limit = min(int(limit), 500) if limit is not None and str(limit).isdigit() else max_results
    first, last = ts.day_bounds(params.get("from"), params.get("to"))
    return ft.search(index, params.get("q", ""), limit, params.get("collection") or None, int(first) if first else None, int(last) if last else None, skip)


def search_page(index: ft.Index, params: dict, skip: SkipList | None = None, max_results: int = 50) -> DataFrame:
    """Four times as many hits, 400 at most, grouped by domain."""
    return ft.group_by_domain(search(index, {**params, "limit": min(4 * int(params.get("limit") or max_results), 400)}, skip))


def browse(captures: DataFrame, tld: str | None = None, domain: str | None = None, host: str | None = None, show_all: bool = False, limit: int | None = None) -> DataFrame:
    """Host before domain before top-level domain: runs of captures, hosts, domains, or top-level domains. A domain without
    exactly one dot is taken as a host. One row more than the limit tells that there are more."""
    reverse = lambda x: ",".join(reversed(x.lower().split(".")))
    if host or (domain and domain.count(".") != 1):
        rows, level = cp.browse_captures(captures.filter(F.col("surt_url").startswith(reverse(host or domain) + ")")), show_all).orderBy("surt_url", "run"), 5000
    elif domain:
        rows, level = st.browse_subdomains(captures, reverse(domain)), 500
    elif tld is not None:
        rows, level = st.browse_domains(captures, tld), 2000
    else:
        rows, level = st.browse_tlds(captures), 500
    return rows.limit((limit or level) + 1)


def rejected_patterns(skip: SkipList) -> list[str]:
    """Configured patterns that aren't active."""
    return [p for p in skip.patterns if p not in skip.active]
