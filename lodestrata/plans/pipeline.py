"""Indexing WARC files: records to captures, documents and provenance, with replace on re-index and a state of what is done."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import http
from lodestrata.functions import text as tx
from lodestrata.functions.skiplist import SkipList
from lodestrata.functions.urls import is_bookkeeping_url, to_surt
from lodestrata.operators.captures import is_indexable
from lodestrata.operators.upsert import new_or_changed, upsert, without_files
from lodestrata.sources import warc
from lodestrata.store import materialize

MAX_TEXT_BYTES = 524_288


def read_warcs(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    warc.register(spark)
    return spark.read.format("warc").option("mode", mode).load(path)


def captures_of(records: DataFrame, collection: str = "warc", skip: SkipList | None = None) -> DataFrame:
    """The capture rows of responses, resources and revisits. Records without a URL or a valid date give none, nor do
    bookkeeping records and what the skip list names. The type is the HTTP message's if the record says it is one."""
    rows = records.filter(F.col("error").isNull() & F.col("record_type").isin("response", "resource", "revisit"))
    rows = rows.withColumn("http", http.http_parts(F.col("block")))
    own = F.col("content_type")
    is_http = own.isNull() | F.lower(own).startswith("application/http")
    mime = F.lower(F.trim(F.substring_index(F.when(is_http, F.col("http.content_type")).otherwise(own), ";", 1)))
    captured = F.col("warc_date").try_cast("timestamp")
    out = rows.select(
        to_surt(F.col("target_uri")).alias("surt_url"), F.date_format(captured, "yyyyMMddHHmmss").alias("timestamp"), F.col("target_uri").alias("original"),
        F.when(mime != "", mime).alias("mime"), F.when(is_http, F.col("http.status")).alias("status"), F.coalesce("payload_digest", "block_digest").alias("digest"), "s3_key", "offset",
        F.col("content_length").alias("length"), "c_offset", F.lit(collection).alias("collection"), "record_type", F.col("http.payload").alias("payload"), F.col("http.error").alias("payload_error"),
    ).filter("surt_url is not null and timestamp is not null")
    out = out.filter(~F.coalesce(is_bookkeeping_url(F.col("original")), F.lit(False)))
    return out.filter(~skip.listed(F.col("original"))) if skip else out


def documents_of(captures: DataFrame) -> DataFrame:
    """Full-text records of captures with their payload: HTML with its title, plain text with its first line as title; not
    of revisits, nor of what is no http(s) or can't be decoded. PDF text comes from the cache of extracted texts."""
    mime = F.col("mime")
    html = mime.startswith("text/html") | mime.startswith("application/xhtml") | mime.rlike("^(?:text|application)/xml")
    raw = tx.utf8_lossy(F.col("payload"))
    rows = captures.filter((F.col("record_type") != "revisit") & F.col("original").rlike("(?i)^https?://") & is_indexable(mime) & F.col("payload").isNotNull())
    rows = rows.filter(~mime.startswith("application/pdf"))
    body = F.when(html, tx.strip_html(raw)).otherwise(tx.plain_body(raw))
    return rows.select(
        F.col("original").alias("url"), F.col("timestamp").cast("bigint").alias("timestamp"), F.when(html, tx.html_title(raw)).otherwise(tx.plain_title(raw)).alias("title"),
        tx.truncate_bytes(body, MAX_TEXT_BYTES).alias("body"), "mime", "s3_key", "offset", "length", "collection",
    )


def pdf_documents(captures: DataFrame, cache: DataFrame) -> DataFrame:
    """Full-text records of PDF captures whose text the cache (digest, title, body) has and the quality gate lets pass."""
    own = captures.filter(F.col("mime").startswith("application/pdf") & F.col("digest").isNotNull()).join(cache.select("digest", F.col("title").alias("_t"), "body"), "digest")
    title = F.coalesce(F.when(F.col("_t") != "", F.col("_t")), tx.title_from_url(F.col("original")))
    body = tx.historic_forms(F.col("body"))
    rows = own.select(F.col("original").alias("url"), F.col("timestamp").cast("bigint").alias("timestamp"), title.alias("title"), body.alias("body"), "mime", "s3_key", "offset", "length", "collection")
    return rows.filter(tx.looks_like_text(F.col("body")))


def warcinfo_of(records: DataFrame) -> DataFrame:
    """The first warcinfo record of each file."""
    rows = records.filter(F.col("error").isNull() & (F.col("record_type") == "warcinfo"))
    pairs = F.to_json(F.transform("headers", lambda h: F.array(h["name"], h["value"])))
    best = rows.groupBy("s3_key").agg(F.min_by(F.struct("warc_date", "record_id", pairs.alias("headers_json"), tx.utf8_lossy(F.col("block")).alias("block_text")), "offset").alias("b"))
    return best.select("s3_key", "b.*")


def outcomes_of(records: DataFrame) -> DataFrame:
    """(s3_key, warc_records, errors, warc_date_min, warc_date_max, outcome): a file with an error is partial and isn't
    marked as done."""
    rows = records.groupBy("s3_key").agg(F.count_if(F.col("error").isNull()).alias("warc_records"), F.count("error").alias("errors"), F.min("warc_date").alias("warc_date_min"), F.max("warc_date").alias("warc_date_max"))
    return rows.withColumn("outcome", F.when(F.col("errors") > 0, "partial").otherwise("done"))


_KEEP = ["surt_url", "timestamp", "original", "mime", "status", "digest", "s3_key", "offset", "length", "c_offset", "collection"]


def index_run(records: DataFrame, captures: DataFrame, docs: DataFrame, skip: SkipList | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captures, docs, outcomes) after the records of new or changed files came in.

    A file that was read to its end replaces its old rows, also if it has none any more. A file with an unreadable record
    keeps them: what was read of it is added, rows of the same place being written anew. Of captures with the same URL and
    second the last written stands. Records are read and decoded once, into the shared folder.
    """
    records = materialize(records, "records")
    outcomes = materialize(outcomes_of(records), "outcomes")
    found = materialize(captures_of(records, skip=skip), "found")
    new_docs = materialize(documents_of(found), "documents")
    done = outcomes.filter("outcome = 'done'")
    kept = without_files(captures.select(*_KEEP), done)
    kept_docs = without_files(docs, done).join(new_docs.select("s3_key", "offset"), ["s3_key", "offset"], "left_anti")
    return upsert(kept, found.select(*_KEEP), ["surt_url", "timestamp"], ["s3_key", "offset"]), kept_docs.unionByName(new_docs, allowMissingColumns=True), outcomes


def pending(listing: DataFrame, state: DataFrame) -> DataFrame:
    return new_or_changed(listing, state)


def new_state(state: DataFrame, listing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The state with the files that were really done."""
    done = listing.join(outcomes.filter("outcome = 'done'").select(F.col("s3_key").alias("key")), "key", "left_semi").select("key", "etag")
    return state.join(done.select("key"), "key", "left_anti").select("key", "etag").unionByName(done)


def wire_scan(captures: DataFrame, folder: str, per_file: int) -> DataFrame:
    """(s3_key, indexable, sampled, damaged, chunked, estimate): samples of every file's records by their wire format, read
    by offset in one pass for each file; the estimate is indexable x damaged / sampled (a sample is the feature)."""
    from lodestrata.operators.captures import sample_indexable
    from lodestrata.operators.statistics import indexable_by_file

    sample = sample_indexable(captures, per_file).join(captures.select("s3_key", "offset", "surt_url", "timestamp", "c_offset", "mime"), ["s3_key", "offset", "surt_url", "timestamp"])

    def classify(batches):
        for rows in batches:
            kinds = []
            for r in rows.sort_values(["s3_key", "offset"]).itertuples():
                try:
                    block = warc.read_at(f"{folder}/{r.s3_key}", int(r.offset), None if pd.isna(r.c_offset) else int(r.c_offset))
                    kinds.append((r.s3_key, http.wire_class(http.parse_block(block), str(r.mime).startswith("application/pdf"))))
                except (OSError, ValueError):
                    kinds.append((r.s3_key, "unreadable"))
            yield pd.DataFrame(kinds, columns=["s3_key", "kind"])

    kinds = sample.select("s3_key", "offset", "c_offset", "mime").repartition("s3_key").mapInPandas(classify, "s3_key string, kind string")
    sums = kinds.groupBy("s3_key").agg(F.count_if(F.col("kind") != "unreadable").alias("sampled"), F.count_if(F.col("kind") == "encoded").alias("damaged"), F.count_if(F.col("kind") == "chunked").alias("chunked"))
    rows = indexable_by_file(captures).withColumnRenamed("n", "indexable").join(sums, "s3_key")
    return rows.withColumn("estimate", F.when(F.col("sampled") > 0, F.round(F.col("indexable") * F.col("damaged") / F.col("sampled")).cast("bigint")).otherwise(0)).withColumn("needs_reindex", F.col("damaged") > 0)
