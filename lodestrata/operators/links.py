"""URL export, and the caches and queues of text extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators.upsert import last_by

_HTTP = r"(?i)^https?://"


def _all(captured: DataFrame, linked: DataFrame) -> DataFrame:
    return captured.select("url").union(linked.select("url")).filter("url is not null").distinct()


def merged_urls(captured: DataFrame, linked: DataFrame, skipped: Column) -> DataFrame:
    """The distinct http(s) URLs of both that aren't skipped, in order."""
    return _all(captured, linked).filter(F.col("url").rlike(_HTTP) & ~skipped).orderBy("url")


def merge_report(captured: DataFrame, linked: DataFrame, skipped: Column) -> DataFrame:
    """(captured, linked, not_http, blacklisted, urls): captured URLs and occurrences of links, then, after duplicates
    are gone, what isn't http(s), what is skipped, and what remains."""
    part = lambda df, k: df.filter("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
    rows = part(captured, 0).union(part(linked, 1)).groupBy("url").agg(F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("l"))
    http = F.col("url").rlike(_HTTP)
    return rows.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("captured"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("linked"),
        F.count_if(~http).alias("not_http"),
        F.count_if(http & skipped).alias("blacklisted"),
        F.count_if(http & ~skipped).alias("urls"),
    )


def page_links(pages: DataFrame, pdf_only: bool = True) -> DataFrame:
    """(url, link): one row for each occurrence of a link in pages (url, html)."""
    f = tx.pdf_links if pdf_only else tx.links
    return pages.select("url", F.explode(f(F.col("url"), F.col("html"))).alias("link"))


def cache_lookup(captures: DataFrame, cache: DataFrame) -> DataFrame:
    """(surt_url, timestamp, digest, outcome): hit, negative (known to give no text), or miss."""
    own = cache.filter("digest is not null").groupBy("digest").agg(F.max("body").alias("body"))
    outcome = F.when(F.col("body").isNull(), "miss").when(F.col("body") == "", "negative").otherwise("hit")
    return captures.join(own, "digest", "left").select("surt_url", "timestamp", "digest", outcome.alias("outcome"))


def enqueue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """The queue (digest, attempts, enqueued, ...) with new jobs; of a digest the last job stands."""
    return last_by(queue.unionByName(jobs, allowMissingColumns=True), ["digest"], ["enqueued", "attempts"])


def settle(queue: DataFrame, outcomes: DataFrame, max_attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, texts, failed) after a run: outcomes (digest, kind, text) with kind text, empty or transient. Texts and
    empty results go to the cache, transient failures are tried again until max_attempts."""
    rows = queue.join(outcomes, "digest", "left")
    done = F.col("kind").isin("text", "empty")
    tried = rows.filter("kind = 'transient'").withColumn("attempts", F.col("attempts") + 1)
    texts = rows.filter(done).select("digest", F.when(F.col("kind") == "text", F.col("text")).otherwise("").alias("body"))
    again = rows.filter("kind is null").unionByName(tried.filter(F.col("attempts") < max_attempts)).drop("kind", "text")
    return again, texts, tried.filter(F.col("attempts") >= max_attempts).drop("kind", "text")


def prefill(captures: DataFrame, cache: DataFrame) -> DataFrame:
    """The digests of PDF captures that the cache lacks, each once."""
    own = captures.filter((F.col("collection") == "warc") & F.lower("mime").startswith("application/pdf") & F.col("digest").isNotNull())
    return own.select("digest").distinct().join(cache.select("digest"), "digest", "left_anti")
