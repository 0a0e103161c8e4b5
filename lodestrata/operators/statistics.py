"""Counts over captures and files. Each is one scan with partial aggregation before the shuffle; ties are broken by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.captures import is_indexable


def count(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count("*").alias("n"))


def basic_stats(captures: DataFrame) -> DataFrame:
    """Captures, distinct URLs and files, first and last time; null times for an empty table."""
    return captures.agg(
        F.count("*").alias("captures"),
        F.count_distinct("surt_url").alias("urls"),
        F.count_distinct("s3_key").alias("files"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def mime_counts(captures: DataFrame, n: int = 20) -> DataFrame:
    """The commonest types (a top-k report), null as ``(none)``."""
    return captures.groupBy(F.coalesce("mime", F.lit("(none)")).alias("mime")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mime").limit(n)


def status_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def collection_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy(F.coalesce("collection", F.lit("warc")).alias("collection")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection")


def breakdowns(captures: DataFrame) -> DataFrame:
    """Type, status and collection counts of one scan, by grouping sets: (kind, key, n)."""
    rows = captures.select(F.coalesce("mime", F.lit("(none)")).alias("mime"), F.coalesce(F.col("status").cast("string"), F.lit("(none)")).alias("status"), F.coalesce("collection", F.lit("warc")).alias("collection"))
    sets = rows.groupingSets([["mime"], ["status"], ["collection"]], "mime", "status", "collection").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "mime").when(F.col("g") == 5, "status").otherwise("collection")
    return sets.select(kind.alias("kind"), F.coalesce("mime", "status", "collection").alias("key"), "n")


def collection_cards(captures: DataFrame, named: list[str]) -> DataFrame:
    """Configured collections with captures, and ``warc`` for the rest of the total; nothing if no named one has any."""
    own = F.when(F.col("collection").isin(named), F.col("collection")).otherwise("warc")
    counts = captures.groupBy(own.alias("collection")).agg(F.count("*").alias("n"))
    any_named = F.max(F.col("collection").isin(named)).over(Window.partitionBy(F.lit(1)))  # over a few counts
    return counts.withColumn("_any", any_named).filter("_any").drop("_any").orderBy(F.desc("n"), "collection")


def indexable_by_file(captures: DataFrame) -> DataFrame:
    rows = captures.filter((F.col("collection") == "warc") & is_indexable(F.col("mime")))
    return rows.groupBy("s3_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s3_key")


def _host(surt: Column) -> Column:
    """The reversed host without port; keys are made of it only, so that commas in paths don't matter."""
    return F.substring_index(F.substring_index(surt, ")", 1), ":", 1)


def browse_tlds(captures: DataFrame) -> DataFrame:
    host = _host(F.col("surt_url"))
    key = F.when(F.instr(host, ",") > 0, F.substring_index(host, ",", 1)).otherwise("")
    return captures.groupBy(key.alias("tld")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tld")


def browse_domains(captures: DataFrame, tld: str | None = None) -> DataFrame:
    """Two-label domains with the captures of all their hosts."""
    rows = captures.withColumn("domain", F.substring_index(_host(F.col("surt_url")), ",", 2))
    rows = rows.filter(F.col("domain").startswith(f"{tld},")) if tld else rows
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("surt_url").alias("urls")).orderBy(F.desc("n"), "domain")


def browse_subdomains(captures: DataFrame, domain_surt: str) -> DataFrame:
    """The apex and all subdomains of a reversed domain."""
    host = F.substring_index("surt_url", ")", 1)
    bare = _host(F.col("surt_url"))
    rows = captures.filter((bare == domain_surt) | bare.startswith(f"{domain_surt},"))
    return rows.groupBy(host.alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


def file_stats(captures: DataFrame) -> DataFrame:
    """By file: captures, bytes, first and last time, and a histogram of types as JSON in the types' order."""
    by_type = captures.groupBy("s3_key", "mime").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("mime").isNotNull(), F.struct("mime", "n"))))
    return by_type.groupBy("s3_key").agg(
        F.sum("n").alias("captures"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"), F.to_json(F.map_from_entries(pairs)).alias("mimes")
    )


def run_totals(files: DataFrame) -> DataFrame:
    """Sums over the files of a run."""
    return files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("warc_records", "cdx_new", "cdx_known", "fulltext_indexed", "skipped", "errors", "size_bytes")], F.count("*").alias("files"))


def api_stats(captures: DataFrame, docs: DataFrame) -> DataFrame:
    """The statistics endpoint: one JSON text."""
    stats = basic_stats(captures).withColumn("num_docs", F.lit(docs.count()))
    return stats.select(F.to_json(F.struct("captures", "urls", "files", "first", "last", "num_docs")).alias("json"))
