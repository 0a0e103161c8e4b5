"""Maintenance: reading records by place, URL export, text extraction, sidecars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import http
from lodestrata.functions import text as tx
from lodestrata.operators import captures as cp
from lodestrata.operators import links as ln
from lodestrata.operators.upsert import CDX_HEADER, cdx_lines
from lodestrata.sources import warc
from lodestrata.store import drop_path


def fetch_records(captures: DataFrame, folder: str) -> DataFrame:
    """The captures with their record's block, or the reason why it can't be read. Rows are spread by file and sorted by
    place, so each file is read from front to back."""

    def read(batches):
        for rows in batches:
            blocks, errors = [], []
            for r in rows.itertuples():
                try:
                    blocks.append(warc.read_at(f"{folder}/{r.s3_key}", int(r.offset), None if pd.isna(r.c_offset) else int(r.c_offset)))
                    errors.append(None)
                except (OSError, ValueError, StopIteration) as e:
                    blocks.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield rows.assign(block=blocks, read_error=errors)

    spread = captures.repartition("s3_key").sortWithinPartitions("s3_key", "offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.schema) + ", block binary, read_error string"
    return spread.mapInPandas(read, schema)


def export_pdf_urls(captures: DataFrame, folder: str, skipped: Column, cached_xhtml: DataFrame | None = None) -> DataFrame:
    """PDF URLs that were captured, or are linked in the archive's HTML or in the cached XHTML (url, html) of PDFs."""
    pages = fetch_records(cp.html_captures(captures), folder).filter("block is not null").withColumn("http", http.http_parts(F.col("block")))
    pages = pages.filter("http.payload is not null").select(F.col("original").alias("url"), tx.utf8_lossy(F.col("http.payload")).alias("html"))
    pages = pages.unionByName(cached_xhtml.select("url", "html")) if cached_xhtml is not None else pages
    return ln.merged_urls(cp.pdf_urls(captures).select(F.col("original").alias("url")), ln.page_links(pages).select(F.col("link").alias("url")), skipped)


def write_lines(rows: DataFrame, column: str, path: str, header: str | None = None) -> bool:
    """One text file, in order; nothing is written for no rows."""
    ordered = rows.select(F.col(column).alias("value")).distinct().orderBy("value")
    if not ordered.limit(1).count():
        return False
    spark = rows.sparkSession
    out = ordered.coalesce(1)
    if header is not None:
        out = spark.createDataFrame([(header,)], "value string").coalesce(1).union(out).coalesce(1)
    out.write.mode("overwrite").text(path)
    return True


def write_sidecars(captures: DataFrame, folder: str, done: DataFrame | None = None) -> None:
    """The index lines of every file that has none yet, a folder for each file; folders of other files stay as they are."""
    lines = cdx_lines(captures)
    lines = lines.join(done.select("s3_key"), "s3_key", "left_anti") if done is not None else lines
    header = lines.select("s3_key").distinct().withColumn("line", F.lit(CDX_HEADER))
    rows = lines.withColumn("k", F.lit(1)).unionByName(header.withColumn("k", F.lit(0)))
    rows.repartition("s3_key").sortWithinPartitions("s3_key", "k", "line").select("s3_key", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("s3_key").text(folder)


Extractor = Callable[[bytes], tuple[str, str]]


def extract_texts(jobs: DataFrame, extract: Extractor, max_bytes: int = 100 << 20) -> DataFrame:
    """(digest, kind, title, text) for jobs (digest, content): kind is text, empty (kept as a known failure: nothing found,
    too large, no end mark, or not like text) or transient (to be tried again)."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                content = bytes(r.content or b"")
                if not content or len(content) > max_bytes or b"%%EOF" not in content[-4096:]:
                    out.append((r.digest, "empty", "", ""))
                    continue
                try:
                    title, text = extract(content)
                    out.append((r.digest, "text" if text.strip() else "empty", title or "", text if text.strip() else ""))
                except Exception:  # whatever the service raises is worth another try
                    out.append((r.digest, "transient", "", ""))
            yield pd.DataFrame(out, columns=["digest", "kind", "title", "text"])

    found = jobs.select("digest", "content").mapInPandas(run, "digest string, kind string, title string, text string")
    text = tx.historic_forms(F.col("text"))
    poor = (F.col("kind") == "text") & ~tx.looks_like_text(text)
    return found.select("digest", F.when(poor, "empty").otherwise(F.col("kind")).alias("kind"), "title", F.when(poor, "").otherwise(text).alias("text"))


def sidecar_texts(objects: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Objects (key, etag) with the text extracted from just that version, null where it must be extracted."""
    return objects.join(sidecars.select("key", "etag", "title", "text"), ["key", "etag"], "left")


def run_files(listing: DataFrame, only: str | None = None, max_files: int | None = None) -> DataFrame:
    """The files of a run: one by name, or the first ones in order (a limit is the feature)."""
    rows = listing.filter(F.col("key") == only) if only else listing.orderBy("key")
    return rows.limit(max_files) if max_files is not None else rows


def recompress_all(spark: SparkSession, paths: list[str], suffix: str = ".new", salvage: bool = False) -> DataFrame:
    """Rewrite files with one gzip member a record, a file a task; (path, outcome, records, bytes)."""

    def run(batches):
        for rows in batches:
            got = [(p, warc.recompress(p, p + suffix, salvage)) for p in rows["path"]]
            yield pd.DataFrame([(p, g["outcome"], g["records"], g["bytes"]) for p, g in got], columns=["path", "outcome", "records", "bytes"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return rows.mapInPandas(run, "path string, outcome string, records long, bytes long")


def drop(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)
