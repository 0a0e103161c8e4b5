"""Lookups among captures: exact, range, prefix, closest in time, and what the endpoints make of them.

All take the captures table (surt_url, timestamp, original, mime, status, digest, s3_key, offset, length, c_offset,
collection). Where an order is given it is made total by further keys, so that limits are deterministic. Rows with a null
key are in no result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import timestamps as ts

INDEXABLE = ("text/html", "application/xhtml", "text/plain", "application/pdf", "text/xml", "application/xml")
_TIE = ("s3_key", "offset")


def by_surt(captures: DataFrame, surt: str) -> DataFrame:
    return captures.filter(F.col("surt_url") == surt).orderBy("timestamp", *_TIE)


def by_surt_range(captures: DataFrame, surt: str, first: str, last: str) -> DataFrame:
    """Both bounds included, compared as text."""
    return captures.filter((F.col("surt_url") == surt) & F.col("timestamp").between(first, last)).orderBy("timestamp", *_TIE)


def by_prefix(captures: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """SURTs with this prefix, pushed to the scan; an empty prefix finds nothing."""
    rows = captures.filter(F.col("surt_url").startswith(prefix) if prefix else F.lit(False)).orderBy("surt_url", "timestamp", *_TIE)
    return rows if limit is None else rows.limit(limit)


def closest(captures: DataFrame, surt: str, at: str, metric: str = "digits") -> DataFrame:
    """The capture of a URL nearest to a 14-digit time, the earlier one on a tie."""
    rows = captures.filter((F.col("surt_url") == surt) & ts.is_valid(F.lit(at)))
    return rows.withColumn("_d", ts.distance(F.col("timestamp"), F.lit(at), metric)).orderBy("_d", "timestamp", *_TIE).limit(1).drop("_d")


#: Captures of a URL are ordered within the days of their times, and days among each other, so that a URL that holds a
#: large part of all captures is in many tasks.
_DAY = 8


def closest_each(probes: DataFrame, captures: DataFrame, metric: str = "digits") -> DataFrame:
    """For every probe (probe_id, surt_url, at) the nearest capture of its URL, the earlier one on a tie.

    An as-of merge: probes and captures, first reduced to one for each URL and time, are sorted together by URL and day, and
    the captures next to a probe are taken from its day; those of the nearest other days come from a table of each day's
    first and last capture. So no pairs are listed, however many captures and probes a URL has. Captures and probes without
    a valid time are left out; of a probe_id that comes twice the nearest capture of all its rows is given.
    """
    one = F.struct("timestamp", F.min(F.struct("s3_key", "offset", "status")).alias("c"))
    own = captures.filter(F.col("surt_url").isNotNull() & ts.is_valid(F.col("timestamp"))).groupBy("surt_url", "timestamp").agg(one.alias("here"))
    own = own.select("surt_url", F.left("timestamp", F.lit(_DAY)).alias("day"), F.col("timestamp").alias("t"), "here")
    asked = probes.filter(F.col("surt_url").isNotNull() & ts.is_valid(F.col("at"))).select("surt_url", F.left("at", F.lit(_DAY)).alias("day"), F.col("at").alias("t"), "probe_id")
    days = own.groupBy("surt_url", "day").agg(F.min("here").alias("first"), F.max("here").alias("last")).unionByName(asked.select("surt_url", "day").distinct(), allowMissingColumns=True)
    days = days.groupBy("surt_url", "day").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    among = Window.partitionBy("surt_url").orderBy("day")
    days = days.select(
        "surt_url", "day", F.last("last", True).over(among.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(among.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    )
    within = Window.partitionBy("surt_url", "day").orderBy("t", F.col("probe_id").isNotNull())
    merged = own.unionByName(asked, allowMissingColumns=True)
    merged = merged.withColumn("below", F.last("here", True).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first("here", True).over(within.rowsBetween(0, Window.unboundedFollowing)))
    near = merged.filter("probe_id is not null").join(days, ["surt_url", "day"])
    far = lambda x: F.struct(ts.distance(x["timestamp"], F.col("t"), metric).alias("distance"), x["timestamp"].alias("timestamp"), x["c"]["s3_key"].alias("s3_key"), x["c"]["offset"].alias("offset"), x["c"]["status"].alias("status"))
    best = F.array_min(F.transform(F.array_compact(F.array("below", "above", "before", "after")), far))
    return near.select("probe_id", best.alias("b")).filter("b is not null").groupBy("probe_id").agg(F.min("b").alias("b")).select("probe_id", "b.*")


def newest_each(captures: DataFrame) -> DataFrame:
    """(surt_url, timestamp, s3_key, offset): the last capture of every URL."""
    best = captures.filter("surt_url is not null").groupBy("surt_url").agg(F.max(F.struct("timestamp", "s3_key", "offset")).alias("b"))
    return best.select("surt_url", "b.*")


def exists(captures: DataFrame, surt: str, timestamp: str) -> DataFrame:
    return captures.filter((F.col("surt_url") == surt) & (F.col("timestamp") == timestamp)).agg((F.count("*") > 0).alias("found"))


def of_domain(surt: Column, domain_surt: str) -> Column:
    """Apex or subdomain of a reversed host."""
    return surt.startswith(f"{domain_surt})") | surt.startswith(f"{domain_surt},") | surt.startswith(f"{domain_surt}:")


def originals_of_domain(captures: DataFrame, domain_surt: str) -> DataFrame:
    return captures.filter(of_domain(F.col("surt_url"), domain_surt)).select("original").distinct()


def urls_matching(captures: DataFrame, predicate: Column) -> DataFrame:
    """(surt_url, original): the earliest matching URL of every SURT."""
    rows = captures.filter(predicate).groupBy("surt_url").agg(F.min(F.struct("timestamp", "original")).alias("b"))
    return rows.select("surt_url", "b.original")


def pdf_urls(captures: DataFrame) -> DataFrame:
    return captures.filter(F.lower("mime").startswith("application/pdf")).select("original").distinct()


def is_indexable(mime: Column) -> Column:
    result = F.lit(False)
    for m in INDEXABLE:
        result = result | F.lower(mime).startswith(m)
    return F.coalesce(result, F.lit(False))


def sample_indexable(captures: DataFrame, n: int) -> DataFrame:
    """The n first captures with indexable content of every file (a sample is the feature)."""
    w = Window.partitionBy("s3_key").orderBy("timestamp", "offset", "surt_url")
    rows = captures.filter((F.col("collection") == "warc") & is_indexable(F.col("mime")))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("s3_key", "rank", "surt_url", "timestamp", "offset")


def html_captures(captures: DataFrame) -> DataFrame:
    return captures.filter((F.col("collection") == "warc") & (F.lower("mime").startswith("text/html") | F.lower("mime").startswith("application/xhtml")))


def pdf_captures(captures: DataFrame) -> DataFrame:
    return captures.filter((F.col("collection") == "warc") & F.lower("mime").startswith("application/pdf") & F.col("digest").isNotNull())


def recent_files(files: DataFrame, n: int = 200) -> DataFrame:
    """The files indexed last (a top-k report)."""
    return files.orderBy(F.desc("last_indexed"), "s3_key").limit(n)


_CDX = ("surt_url", "timestamp", "original", "mime", "status", "digest", "length")


def cdx_rows(rows: DataFrame) -> DataFrame:
    """Seven columns as text, null as a dash."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in _CDX])


def cdx_lookup(captures: DataFrame, surt: str, match: str = "exact", first: str = "", last: str = "9" * 14, limit: int = 100, strict: bool = False) -> DataFrame:
    """The lookup endpoint. A prefix match takes the host only and ignores times, an exact one ignores the limit, unless
    ``strict``."""
    limit = min(limit, 10_000)
    if match == "prefix":
        rows = by_prefix(captures, surt if strict else surt.partition(")")[0] + ")")
        rows = rows.filter(F.col("timestamp").between(first, last)) if strict else rows
        return cdx_rows(rows.limit(limit))
    rows = by_surt_range(captures, surt, first, last)
    return cdx_rows(rows.limit(limit) if strict else rows)


def timemap(captures: DataFrame, surt: str, limit: int | None = None) -> DataFrame:
    """Space-joined lines, oldest first; a negative limit gives the newest first. A digest loses its algorithm."""
    rows = captures.filter(F.col("surt_url") == surt)
    order = [F.desc("timestamp"), *map(F.desc, _TIE)] if limit is not None and limit < 0 else ["timestamp", *_TIE]
    rows = rows.orderBy(*order)
    rows = rows if limit is None else rows.limit(abs(limit))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    digest = F.coalesce(F.regexp_replace("digest", r"^[^:]*:", ""), F.lit("-"))
    return rows.select(F.concat_ws(" ", part("surt_url"), part("timestamp"), part("original"), part("mime"), part("status"), digest, part("length")).alias("line"))


def browse_captures(captures: DataFrame, show_all: bool = False) -> DataFrame:
    """(surt_url, original, run, captures, ok): runs of consecutive captures with the same original URL within a SURT, with
    their number and whether any was a success; runs without one are hidden unless ``show_all``."""
    order = ["timestamp", *_TIE]
    rows = captures.filter("surt_url is not null").select("surt_url", "original", "status", *order, F.coalesce(F.left("timestamp", F.lit(_DAY)), F.lit("")).alias("day"))
    within = Window.partitionBy("surt_url", "day").orderBy(*order)
    changed = F.coalesce(F.lag("original").over(within) != F.col("original"), F.lit(True)) & (F.row_number().over(within) > 1)
    rows = rows.withColumn("start", changed.cast("int"))
    # a day's first capture begins a run if it differs from the last one of the day before; runs are counted over the days
    days = rows.groupBy("surt_url", "day").agg(F.min_by("original", F.struct(*order)).alias("first"), F.max_by("original", F.struct(*order)).alias("last"), F.sum("start").alias("inner"))
    among = Window.partitionBy("surt_url").orderBy("day")
    days = days.withColumn("head", F.coalesce(F.lag("last").over(among) != F.col("first"), F.lit(True)).cast("int"))
    days = days.select("surt_url", "day", (F.sum(F.col("head") + F.col("inner")).over(among) - F.col("inner")).alias("base"))
    rows = rows.withColumn("own", F.sum("start").over(within)).join(days, ["surt_url", "day"]).withColumn("run", F.col("base") + F.col("own"))
    runs = rows.groupBy("surt_url", "run").agg(
        F.first("original").alias("original"), F.count("*").alias("captures"), F.coalesce(F.bool_or(F.col("status").between(200, 299)), F.lit(False)).alias("ok")
    )
    return runs if show_all else runs.filter("ok")
