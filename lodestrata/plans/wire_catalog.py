"""Registered queries on records as they come from archive files, and on what the index keeps beside captures.

The test tables hold no archive files, so records are set up from their rows: every document becomes the HTTP response it
was taken from, every other one in chunks, and every warcinfo row its record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import http
from lodestrata.functions import text as tx
from lodestrata.functions import timestamps as ts
from lodestrata.functions import urls as ur
from lodestrata.operators import links as ln
from lodestrata.operators import upsert as up
from lodestrata.plans import pipeline as pl
from lodestrata.plans.catalog import _SURT_SQL, _cdx, _docs, _parts_sql, query
from lodestrata.sources import objects
from lodestrata.store import table

_RECORD = ["s3_key", "offset", "c_offset", "record_type", "record_id", "warc_date", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "headers", "block", "error"]


def _none(kind: str):
    return F.lit(None).cast(kind)


def _records(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a record that they lack, null."""
    kinds = {"offset": "long", "c_offset": "long", "content_length": "long", "headers": "array<struct<name:string,value:string>>", "block": "binary"}
    return rows.select(*[c for c in rows.columns if c not in _RECORD], *[F.col(c) if c in rows.columns else _none(kinds.get(c, "string")).alias(c) for c in _RECORD])


def responses(spark: SparkSession, d: str, mime: str | None = None) -> DataFrame:
    """Every document as a response record, with its rec_id."""
    kind = F.lit(mime) if mime else F.coalesce("mime", F.lit("text/html"))
    body = F.coalesce("body", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), kind, F.lit("; charset=utf-8\r\n"))
    chunk = F.concat(F.hex(F.octet_length(body)), F.lit("\r\n"), body, F.lit("\r\n0\r\n\r\n"))
    block = F.when(F.col("rec_id") % 2 == 1, F.concat(head, F.lit("Transfer-Encoding: chunked\r\n\r\n"), F.when(body == "", F.lit("0\r\n\r\n")).otherwise(chunk))).otherwise(F.concat(head, F.lit("\r\n"), body))
    at = F.lpad(F.col("timestamp").cast("string"), 14, "0")
    date = F.regexp_replace(at, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    return _records(
        _docs(spark, d).select(
            "rec_id", "s3_key", "offset", F.lit("response").alias("record_type"), date.alias("warc_date"), F.col("url").alias("target_uri"), F.lit("application/http; msgtype=response").alias("content_type"),
            F.col("length").alias("content_length"), F.encode(block, "UTF-8").alias("block"),
        )
    )


@query("select rec_id, 200 as status, coalesce(mime, 'text/html') || '; charset=utf-8' as content_type, rec_id % 2 = 1 as chunked, coalesce(body, '') as payload from index_docs")
def http_payloads(spark, d):
    """Status, type and payload of every response, chunks joined."""
    return responses(spark, d).select("rec_id", http.http_parts(F.col("block")).alias("h")).select("rec_id", "h.status", "h.content_type", "h.chunked", F.decode("h.payload", "UTF-8").alias("payload"))


_AT = "lpad(ts::varchar, 14, '0')"


@query(
    f"""select surt_url, {_AT} as timestamp, original, mime, 200 as status, s3_key, "offset", length from
    (select rec_id, {_SURT_SQL} as surt_url, {', '.join(('original', 'ts', 'mime', 's3_key', '"offset"', 'length'))} from
      (select * from {_parts_sql('''(select rec_id, url, url as original, timestamp as ts, lower(coalesce(mime, 'text/html')) as mime, s3_key, "offset", length from index_docs)''', 'url', 'rec_id, original, ts, mime, s3_key, "offset", length')}))
    where surt_url is not null"""
)
def captures_of_records(spark, d):
    """Capture rows from response records."""
    return pl.captures_of(responses(spark, d)).select("surt_url", "timestamp", "original", "mime", "status", "s3_key", "offset", "length")


@query(
    """select url, timestamp, left(trim(split_part(body, chr(10), 1), ' '), 256) as title, case when contains(body, chr(10)) then substr(body, instr(body, chr(10)) + 1) else '' end as body, s3_key, "offset"
    from index_docs where regexp_matches(url, '(?i)^https?://')"""
)
def documents_of_records(spark, d):
    """Full-text records from response records of plain text."""
    return pl.documents_of(pl.captures_of(responses(spark, d, "text/plain"))).select("url", "timestamp", "title", "body", "s3_key", "offset")


@query("select s3_key, warc_date, record_id, json_array_length(headers_json)::int as headers, block_text from warcinfo")
def warcinfo_of_records(spark, d):
    """Each file's provenance from its warcinfo record, headers as pairs."""
    pairs = F.transform(F.from_json("headers_json", "array<array<string>>"), lambda h: F.struct(h[0].alias("name"), h[1].alias("value")))
    rows = table(spark, d, "warcinfo").select("s3_key", F.lit(0).cast("long").alias("offset"), F.lit("warcinfo").alias("record_type"), "warc_date", "record_id", pairs.alias("headers"), F.encode("block_text", "UTF-8").alias("block"))
    return pl.warcinfo_of(_records(rows)).select("s3_key", "warc_date", "record_id", F.size(F.from_json("headers_json", "array<array<string>>")).alias("headers"), "block_text")


@query("select s3_key, count(*) as warc_records, 0::bigint as errors, 'done' as outcome from index_docs group by 1")
def record_outcomes(spark, d):
    """What became of each file: all its records read, so it is done."""
    return pl.outcomes_of(responses(spark, d)).select("s3_key", "warc_records", "errors", "outcome")


@query("select url, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/files/' || rec_id || '.pdf' as link from index_docs where regexp_matches(url, '(?i)^https?://[^/]')")
def pdf_links_of_pages(spark, d):
    """The PDF links of every page, relative ones resolved, entities in them decoded, scripts and other links left out."""
    html = F.concat(F.lit("<p><a href='other.html'>x</a><script>var a = '<a href=\"no.pdf\">';</script><A HREF=\"/files/"), F.col("rec_id"), F.lit("&#46;pdf#page=2\">y</A><!-- <a href='gone.pdf'> -->"))
    return ln.page_links(_docs(spark, d).select("url", html.alias("html"))).select("url", "link")


@query(
    """select rec_id, url_encode(title) as encoded, case when contains(url, '://') then url else 'http://' || url end as schemed, regexp_matches(url, '(?i)^(?:dns:|urn:x-wpull:).') as bookkeeping,
    array_to_string(list_reverse(string_split(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '.')), ',') || ')' as prefix from index_docs"""
)
def url_forms(spark, d):
    host = F.regexp_extract("url", "://([^/:?#]*)", 1)
    return _docs(spark, d).select(
        "rec_id", ur.percent_encode(F.col("title")).alias("encoded"), ur.with_scheme(F.col("url")).alias("schemed"), ur.is_bookkeeping_url(F.col("url")).alias("bookkeeping"), ur.domain_to_surt_prefix(host).alias("prefix")
    )


@query("select surt_url, array_to_string(list_reverse(string_split(split_part(surt_url, ')', 1), ',')), '.') as host from (select distinct surt_url from cdx)")
def surt_hosts(spark, d):
    return _cdx(spark, d).select("surt_url").distinct().select("surt_url", ur.surt_to_domain(F.col("surt_url")).alias("host"))


@query('select surt_url, timestamp, s3_key, "offset", "offset" as first, "offset" + length as last, "offset" + length + 9 as total from cdx')
def content_ranges(spark, d):
    header = F.concat(F.lit("bytes "), F.col("offset"), F.lit("-"), F.col("offset") + F.col("length"), F.lit("/"), F.col("offset") + F.col("length") + 9)
    return _cdx(spark, d).select("surt_url", "timestamp", "s3_key", "offset", ur.content_range(header).alias("r")).select("surt_url", "timestamp", "s3_key", "offset", "r.first", "r.last", "r.total")


@query("select s3_key, last_indexed, left(timestamp, 6) || '01000000' as padded, strftime(last_indexed::timestamptz at time zone 'UTC', '%Y%m%d%H%M%S') as indexed from warc_files join (select s3_key, min(timestamp) as timestamp from cdx group by 1) using (s3_key)")
def timestamp_bounds(spark, d):
    """A file's first month as a bound, and its time of indexing as a capture's time."""
    first = _cdx(spark, d).groupBy("s3_key").agg(F.min("timestamp").alias("timestamp"))
    return table(spark, d, "warc_files").join(first, "s3_key").select("s3_key", "last_indexed", ts.pad(F.left("timestamp", F.lit(6))).alias("padded"), ts.from_iso(F.col("last_indexed")).alias("indexed"))


@query("select s3_key, regexp_matches(lower(s3_key), '\\.warc(\\.gz)?$') as warc, ends_with(lower(s3_key), '.gz') as gzipped, ends_with(lower(s3_key), '.pdf') as pdf from (select distinct s3_key from cdx)")
def object_kinds(spark, d):
    key = F.col("s3_key")
    return _cdx(spark, d).select("s3_key").distinct().select("s3_key", objects.is_warc(key).alias("warc"), objects.is_gzipped(key).alias("gzipped"), objects.is_pdf(key).alias("pdf"))


@query("select surt_url, timestamp, s3_key from cdx where surt_url not in (select surt_url from cdx where status >= 400 and surt_url is not null)")
def delete_surts(spark, d):
    """The captures without the URLs that failed at some time."""
    captures = _cdx(spark, d)
    return up.delete_surts(captures, captures.filter("status >= 400")).select("surt_url", "timestamp", "s3_key")


@query("select surt_url, timestamp, s3_key from cdx where s3_key is distinct from (select max(s3_key) from warc_files)")
def delete_file(spark, d):
    last = table(spark, d, "warc_files").agg(F.max("s3_key")).first()[0]
    return up.delete_file(_cdx(spark, d), last).select("surt_url", "timestamp", "s3_key")


@query("select s3_key, first_seen, warc_records + 1 as warc_records from warc_files union all select s3_key || '.new', last_indexed, warc_records + 1 from warc_files")
def upsert_files(spark, d):
    """All files are written again, and as many new ones: the former keep the time they were first seen."""
    files = table(spark, d, "warc_files").select("s3_key", "first_seen", "last_indexed", "warc_records")
    again = files.withColumn("first_seen", F.col("last_indexed")).withColumn("warc_records", F.col("warc_records") + 1)
    batch = again.union(again.withColumn("s3_key", F.concat("s3_key", F.lit(".new"))))
    return up.upsert_files(files, batch).select("s3_key", "first_seen", "warc_records")


_PREFILL = "select distinct digest from cdx where collection = 'warc' and starts_with(lower(mime), 'application/pdf') and digest is not null and digest not in (select digest from pdf_docs where digest is not null and quality_ok)"


def _prefill(spark, d):
    return ln.prefill(_cdx(spark, d), table(spark, d, "pdf_docs").filter("quality_ok and digest is not null"))


@query(_PREFILL)
def extraction_prefill(spark, d):
    """The PDF captures whose text must be extracted."""
    return _prefill(spark, d)


@query(f"with q as ({_PREFILL}), o as (select digest, max(body) as body from pdf_docs where digest is not null and not quality_ok group by 1) select q.digest, case when coalesce(o.body, '') = '' then '' else o.body end as body from q join o using (digest)")
def extraction_settled(spark, d):
    """The cache's new entries when the queue's jobs come back with what the poor documents hold."""
    queue = _prefill(spark, d).select("digest", F.lit(0).alias("attempts"), F.lit(1).alias("enqueued"))
    body = F.max("body").alias("text")
    outcomes = table(spark, d, "pdf_docs").filter("digest is not null and not quality_ok").groupBy("digest").agg(body).select("digest", F.when(F.coalesce("text", F.lit("")) == "", "empty").otherwise("text").alias("kind"), "text")
    return ln.settle(queue, outcomes)[1]


@query("select pdf_id, left(body, 40) as start from pdf_docs")
def truncated_texts(spark, d):
    """Texts cut to 160 bytes, characters kept whole, begin as the text does."""
    cut = tx.truncate_bytes(F.col("body"), 160)
    return table(spark, d, "pdf_docs").select("pdf_id", F.left(cut, F.lit(40)).alias("start"))
