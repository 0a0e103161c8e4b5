"""Column functions on URLs: SURT keys, domains, prefixes and percent-encoding."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote_plus, unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::[0-9]*)?(?:[/?#]|$)"


def host_of(url: Column) -> Column:
    """The host in lower case without trailing dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r"\.+$", "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def reverse_labels(host: Column) -> Column:
    """Labels of a host in reverse order, joined by commas."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ",")


def to_surt(url: Column) -> Column:
    """Reversed host, ``)``, port unless it is the scheme's own, path and query; null where no host can be found.

    User name and fragment are dropped, an empty path becomes ``/``, ``www.`` stays.
    """
    host, scheme = host_of(url), scheme_of(url)
    port = F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:\[\]]*):([0-9]+)", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    rest = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(reverse_labels(host), F.lit(")"), F.when(own, "").otherwise(F.concat(F.lit(":"), port)), rest))


def domain_to_surt_host(domain: Column) -> Column:
    return reverse_labels(F.lower(domain))


def domain_to_surt_prefix(domain: Column) -> Column:
    return F.concat(domain_to_surt_host(domain), F.lit(")"))


def surt_to_domain(surt_host: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.regexp_replace(surt_host, r"\).*$", ""), ",")), ".")


def surt_host(surt: Column) -> Column:
    """The reversed host before the closing parenthesis."""
    return F.substring_index(surt, ")", 1)


def next_prefix(prefix: str) -> str:
    """The least string after all strings with this prefix; empty if there is none. Spark's ``startswith`` needs it not."""
    data = bytearray(prefix.encode())
    while data and data[-1] == 0xFF:
        data.pop()
    if data:
        data[-1] += 1
    return bytes(data).decode("utf-8", "surrogateescape")


def url_domain(url: Column) -> Column:
    """The last two labels of the host; addresses and single labels stay as they are."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    bare = F.when(authority.startswith("["), F.regexp_extract(authority, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_replace(authority, r":[0-9]*$", ""))
    host = F.lower(F.regexp_replace(bare, r"\.$", ""))
    whole = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.startswith("[") | ~host.contains(".")
    return F.when(whole, host).otherwise(F.substring_index(host, ".", -2))


def is_bookkeeping_url(url: Column) -> Column:
    """Records that crawlers write for themselves."""
    return url.rlike(r"(?i)^(?:dns:|urn:x-wpull:).")


def with_scheme(url: Column, scheme: str = "http") -> Column:
    """A URL given without a scheme gets one."""
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit(f"{scheme}://"), url))


def percent_encode(text: Column) -> Column:
    """All but letters, digits and ``-_.~`` percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def content_range(header: Column) -> Column:
    """``bytes a-b/total`` as a struct; null parts where it doesn't fit."""
    part = lambda k: F.expr("cast(null as bigint)") if k is None else F.regexp_extract(header, r"^bytes ([0-9]+)-([0-9]+)/([0-9]+)$", k).try_cast("bigint")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total"))


def canonical(url: str | None) -> str | None:
    """Host in lower case, no fragment, query pairs decoded, sorted and joined again; None for what is no URL."""
    if not url or "://" not in url:
        return None
    u = urlsplit(url)
    if not u.hostname:
        return None
    pairs = sorted(parse_qsl(u.query, keep_blank_values=True))
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    return f"{u.scheme}://{u.hostname.rstrip('.')}{port}{u.path or '/'}" + (f"?{query}" if query else "")


@F.pandas_udf(StringType())
def canonicalize(url: pd.Series) -> pd.Series:
    return url.map(canonical)


def resolve(base: str, link: str) -> str | None:
    """An absolute http(s) URL without fragment for a link found at ``base``."""
    try:
        u = urlsplit(urljoin(base, link.strip()))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        return u._replace(fragment="").geturl()
    except ValueError:
        return None


def is_pdf_path(url: str) -> bool:
    return unquote_plus(urlsplit(url).path.rsplit("/", 1)[-1]).lower().endswith(".pdf")
