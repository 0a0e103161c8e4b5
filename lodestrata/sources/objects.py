"""Listings of object folders, and collections of PDF objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(key, path, size, last_modified, etag): all files below a folder whose key begins with a prefix. The content is
    never read; without a tag of the store's own, size and time of change stand for it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    base = folder.removeprefix("file://").rstrip("/") + "/"
    key = F.substring_index(F.col("path"), base, -1)
    rows = raw.select(key.alias("key"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    rows = rows.withColumn("etag", F.md5(F.concat_ws("|", "key", F.col("size").cast("string"), F.col("last_modified").cast("string"))))
    return rows.filter((F.col("key") != "") & F.col("key").startswith(prefix))


def is_warc(key: Column) -> Column:
    return F.lower(key).rlike(r"\.warc(\.gz)?$")


def is_pdf(key: Column) -> Column:
    return F.lower(key).endswith(".pdf")


def is_gzipped(key: Column) -> Column:
    return F.lower(key).endswith(".gz")


def pdf_collection(objects: DataFrame, name: str, public_base_url: str, key_pattern: str | None = None) -> DataFrame:
    """Each PDF object of a listing as one capture of the collection; keys that don't fit the pattern are left out."""
    from lodestrata.functions.urls import to_surt

    rows = objects.filter(is_pdf(F.col("key")))
    rows = rows.filter(F.col("key").rlike(key_pattern)) if key_pattern else rows
    url = F.concat(F.lit(public_base_url.rstrip("/") + "/"), F.col("key"))
    return rows.select(
        to_surt(url).alias("surt_url"), F.coalesce(F.date_format("last_modified", "yyyyMMddHHmmss"), F.lit("0" * 14)).alias("timestamp"), url.alias("original"),
        F.lit("application/pdf").alias("mime"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("digest"), F.col("key").alias("s3_key"), F.lit(0).cast("bigint").alias("offset"),
        F.col("size").alias("length"), F.lit(None).cast("bigint").alias("c_offset"), F.lit(name).alias("collection"),
    )
