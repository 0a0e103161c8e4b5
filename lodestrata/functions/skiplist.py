"""Skip lists: hosts and URL patterns that are left out at ingest, purged, and hidden in results. No list is shipped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_domains(text: str) -> list[str]:
    """One host a line; what follows # is comment; lower case, without ``*.``, each once."""
    out = [line.partition("#")[0].strip().lower().removeprefix("*.") for line in text.splitlines()]
    return list(dict.fromkeys(x for x in out if x))


def load_patterns(text: str) -> list[str]:
    """One pattern a line, in order; lines that begin with # are comment."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def compile_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(active, rejected): patterns that don't compile or match the empty text are rejected."""
    active, rejected = [], []
    for p in patterns:
        try:
            (rejected if re.compile(p).search("") else active).append(p)
        except re.error:
            rejected.append(p)
    return active, rejected


@dataclass
class SkipList:
    domains: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.domains = load_domains("\n".join(self.domains))
        self.active, self.rejected = compile_patterns(self.patterns)

    def host_listed(self, host: Column) -> Column:
        """The host itself or a subdomain of a listed one; hosts of one list are few, so this is one expression."""
        own = F.lower(host)
        suffixes = [own.endswith(f".{d}") for d in self.domains]
        result = own.isin(self.domains) if self.domains else F.lit(False)
        for s in suffixes:
            result = result | s
        return F.coalesce(result, F.lit(False))

    def pattern_listed(self, url: Column) -> Column:
        """Any pattern anywhere in the URL, as one alternation."""
        if not self.active:
            return F.lit(False)
        return F.coalesce(url.rlike("|".join(f"(?:{p})" for p in self.active)), F.lit(False))

    def listed(self, url: Column) -> Column:
        """The host rule, for URLs with ``://``, or a pattern."""
        host = F.regexp_extract(url, r"://([^/:?#]*)", 1)
        return (url.contains("://") & self.host_listed(host)) | self.pattern_listed(url)

    def surt_listed(self, surt: Column) -> Column:
        """Apex or subdomain of a listed host, by SURT prefix."""
        result = F.lit(False)
        for d in self.domains:
            key = ",".join(reversed(d.split(".")))
            result = result | surt.startswith(f"{key})") | surt.startswith(f"{key},") | surt.startswith(f"{key}:")
        return result

    def crawler_lines(self) -> list[str]:
        """The active rules as regular expressions for a crawler, hosts included, each once."""
        hosts = [rf"(?i)^https?://([^/]*\.)?{re.escape(d)}([:/?#]|$)" for d in self.domains]
        return list(dict.fromkeys([*self.active, *hosts]))
