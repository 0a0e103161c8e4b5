"""The registered queries over the archive's tables and their SQL.

Each query runs over its whole tables. Where an operator needs a key (a URL, a domain), the key is found in the data by
the same rule in both languages: the URL with most captures, the domain with most captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.functions import timestamps as ts
from lodestrata.functions import urls as ur
from lodestrata.functions.skiplist import SkipList
from lodestrata.operators import captures as cp
from lodestrata.operators import fulltext as ft
from lodestrata.operators import links as ln
from lodestrata.operators import statistics as st
from lodestrata.operators import upsert as up
from lodestrata.store import keep, shared_dir, state_of, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cdx(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cdx")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_docs")


def hot_surt(captures: DataFrame) -> str:
    """The URL with most captures (one value)."""
    row = captures.groupBy("surt_url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surt_url").first()
    return row[0] if row else ""


def hot_domain(captures: DataFrame) -> str:
    row = st.browse_domains(captures).first()
    return row[0] if row else ""


_HOT = "(select surt_url from cdx group by 1 order by count(*) desc, 1 limit 1)"
_HOSTED = "split_part(split_part(surt_url, ')', 1), ':', 1)"
_DOMAIN = f"array_to_string(string_split({_HOSTED}, ',')[1:2], ',')"
_HOT_DOMAIN = f"(select {_DOMAIN} from cdx group by 1 order by count(*) desc, 1 limit 1)"
_OF_DOMAIN = "(starts_with(surt_url, d || ')') or starts_with(surt_url, d || ',') or starts_with(surt_url, d || ':'))"
_INDEXABLE = "(" + " or ".join(f"starts_with(lower(mime), '{m}')" for m in cp.INDEXABLE) + ")"


# --- captures ---------------------------------------------------------------------------------------------------------


@query(f"select * from cdx where surt_url = {_HOT}")
def captures_by_surt(spark, d):
    c = _cdx(spark, d)
    return cp.by_surt(c, hot_surt(c))


@query(f"select * from cdx where surt_url = {_HOT} and timestamp between '2015' and '20191231235959'")
def captures_range(spark, d):
    c = _cdx(spark, d)
    return cp.by_surt_range(c, hot_surt(c), "2015", "20191231235959")


@query(f"select * from cdx where starts_with(surt_url, split_part({_HOT}, ')', 1) || ')')")
def captures_prefix(spark, d):
    c = _cdx(spark, d)
    return cp.by_prefix(c, hot_surt(c).partition(")")[0] + ")")


_SURT_SQL = r"""
case when host <> '' then array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
  || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end
  || case when starts_with(rest, '/') then rest else '/' || rest end end
"""


def _parts_sql(tbl: str, col: str, more: str) -> str:
    return rf"""(select {more}, {col} as url,
      regexp_replace(lower(regexp_extract({col}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::[0-9]*)?(?:[/?#]|$)', 1)), '\.+$', '') as host,
      lower(regexp_extract({col}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
      regexp_extract({col}, '^[^/?#]*//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:\[\]]*):([0-9]+)', 1) as port,
      regexp_extract({col}, '^[^/?#]*//[^/?#]*([^#]*)', 1) as rest from {tbl})"""


@query(f"select rec_id, {_SURT_SQL} as surt from {_parts_sql('index_docs', 'url', 'rec_id')}")
def surt_key(spark, d):
    return _docs(spark, d).select("rec_id", ur.to_surt(F.col("url")).alias("surt"))


@query(
    r"""with p as (select rec_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.$', '') h from index_docs)
    select rec_id, case when regexp_matches(h, '^[0-9]+(\.[0-9]+){3}$') or starts_with(h, '[') or not contains(h, '.') then h
      else array_to_string(string_split(h, '.')[-2:], '.') end as domain from p"""
)
def url_domain(spark, d):
    return _docs(spark, d).select("rec_id", ur.url_domain(F.col("url")).alias("domain"))


def _probes(spark, d):
    return _docs(spark, d).select(F.col("rec_id").alias("probe_id"), ur.to_surt(F.regexp_replace("url", r"://www\.", "://")).alias("surt_url"), F.lpad(F.col("timestamp").cast("string"), 14, "0").alias("at"))


_PROBES_SQL = f"""probes as (select rec_id as probe_id, lpad(ts::varchar, 14, '0') as at, {_SURT_SQL} as surt_url
  from (select rec_id, ts, host, scheme, port, rest from {_parts_sql("(select rec_id, timestamp as ts, replace(url, '://www.', '://') as u from index_docs)", 'u', 'rec_id, ts')}))"""


@query(
    f"""with {_PROBES_SQL}, j as (select probe_id, abs(c.timestamp::bigint - p.at::bigint) as distance, c.timestamp, c.s3_key, c."offset", c.status from probes p join cdx c using (surt_url))
    select probe_id, distance, timestamp, s3_key, "offset", status from j qualify row_number() over (partition by probe_id order by distance, timestamp, s3_key, "offset", status nulls first) = 1"""
)
def closest_capture(spark, d):
    """For every record of the full-text index the nearest capture of its URL."""
    return cp.closest_each(_probes(spark, d), _cdx(spark, d))


@query(
    f"""with {_PROBES_SQL}, j as (select probe_id, abs(epoch(strptime(c.timestamp, '%Y%m%d%H%M%S'))::bigint - epoch(strptime(p.at, '%Y%m%d%H%M%S'))::bigint) as distance, c.timestamp, c.s3_key, c."offset", c.status from probes p join cdx c using (surt_url))
    select probe_id, distance, timestamp, s3_key, "offset", status from j qualify row_number() over (partition by probe_id order by distance, timestamp, s3_key, "offset", status nulls first) = 1"""
)
def closest_capture_seconds(spark, d):
    return cp.closest_each(_probes(spark, d), _cdx(spark, d), "seconds")


@query(f"select surt_url, timestamp from cdx where surt_url = {_HOT} order by abs(timestamp::bigint - 20180630120000), timestamp, s3_key, \"offset\" limit 1")
def closest_one(spark, d):
    c = _cdx(spark, d)
    return cp.closest(c, hot_surt(c), "20180630120000").select("surt_url", "timestamp")


@query("""select surt_url, timestamp, s3_key, "offset" from cdx qualify row_number() over (partition by surt_url order by timestamp desc, s3_key desc, "offset" desc) = 1""")
def newest_capture(spark, d):
    return cp.newest_each(_cdx(spark, d))


@query(f"select count(*) > 0 as found from cdx where surt_url = {_HOT} and timestamp = '20180101000000'")
def capture_exists(spark, d):
    c = _cdx(spark, d)
    return cp.exists(c, hot_surt(c), "20180101000000")


@query(f"with h as (select {_HOT_DOMAIN} as d) select distinct original from cdx, h where {_OF_DOMAIN}")
def domain_originals(spark, d):
    c = _cdx(spark, d)
    return cp.originals_of_domain(c, hot_domain(c))


@query("select surt_url, arg_min(original, struct_pack(t := timestamp, o := original)) as original from cdx where regexp_matches(original, '(?i)\\.(css|js)') group by 1")
def urls_matching(spark, d):
    return cp.urls_matching(_cdx(spark, d), F.col("original").rlike(r"(?i)\.(css|js)"))


@query("select distinct original from cdx where starts_with(lower(mime), 'application/pdf')")
def pdf_urls(spark, d):
    return cp.pdf_urls(_cdx(spark, d))


@query(
    f"""select s3_key, rank::int as rank, surt_url, timestamp, "offset" from (select *, row_number() over (partition by s3_key order by timestamp, "offset", surt_url) as rank from cdx where collection = 'warc' and {_INDEXABLE}) where rank <= 4"""
)
def sample_indexable(spark, d):
    return cp.sample_indexable(_cdx(spark, d), 4)


@query("select surt_url, timestamp, s3_key, \"offset\" from cdx where collection = 'warc' and (starts_with(lower(mime), 'text/html') or starts_with(lower(mime), 'application/xhtml'))")
def html_captures(spark, d):
    return cp.html_captures(_cdx(spark, d)).select("surt_url", "timestamp", "s3_key", "offset")


@query("select surt_url, timestamp, digest from cdx where collection = 'warc' and starts_with(lower(mime), 'application/pdf') and digest is not null")
def pdf_captures(spark, d):
    return cp.pdf_captures(_cdx(spark, d)).select("surt_url", "timestamp", "digest")


@query("select s3_key, last_indexed, warc_records from warc_files order by last_indexed desc, s3_key limit 200")
def recent_warc_files(spark, d):
    return cp.recent_files(table(spark, d, "warc_files")).select("s3_key", "last_indexed", "warc_records")


_DASH = ", ".join(f"coalesce({c}::varchar, '-') as {c}" for c in cp._CDX)


@query(f"select {_DASH} from cdx where surt_url = {_HOT} and timestamp between '2016' and '2021'")
def cdx_api(spark, d):
    c = _cdx(spark, d)
    return cp.cdx_lookup(c, hot_surt(c), first="2016", last="2021")


@query(f"select {_DASH} from (select * from cdx where starts_with(surt_url, split_part({_HOT}, ')', 1) || ')') order by surt_url, timestamp, s3_key, \"offset\" limit 100)")
def cdx_api_prefix(spark, d):
    c = _cdx(spark, d)
    return cp.cdx_lookup(c, hot_surt(c), "prefix")


_LINE = "concat_ws(' ', coalesce(surt_url, '-'), coalesce(timestamp, '-'), coalesce(original, '-'), coalesce(mime, '-'), coalesce(status::varchar, '-'), coalesce(regexp_replace(digest, '^[^:]*:', ''), '-'), coalesce(length::varchar, '-')) as line"


@query(f"select {_LINE} from (select * from cdx where surt_url = {_HOT} order by timestamp, s3_key, \"offset\" limit 25)")
def timemap_oldest(spark, d):
    c = _cdx(spark, d)
    return cp.timemap(c, hot_surt(c), 25)


@query(f"select {_LINE} from (select * from cdx where surt_url = {_HOT} order by timestamp desc, s3_key desc, \"offset\" desc limit 25)")
def timemap_newest(spark, d):
    c = _cdx(spark, d)
    return cp.timemap(c, hot_surt(c), -25)


@query(
    """with a as (select *, case when lag(original) over w is distinct from original then 1 else 0 end as s from cdx window w as (partition by surt_url order by timestamp, s3_key, "offset")),
    b as (select *, sum(s) over (partition by surt_url order by timestamp, s3_key, "offset" rows unbounded preceding) as run from a)
    select surt_url, run::bigint as run, any_value(original) as original, count(*) as captures, coalesce(bool_or(status between 200 and 299), false) as ok from b group by 1, 2 having ok"""
)
def browse_captures(spark, d):
    return cp.browse_captures(_cdx(spark, d))


# --- counts -----------------------------------------------------------------------------------------------------------


@query("select count(*) as n from cdx")
def capture_count(spark, d):
    return st.count(_cdx(spark, d))


@query("select count(*) as captures, count(distinct surt_url) as urls, count(distinct s3_key) as files, min(timestamp) as first, max(timestamp) as last from cdx")
def basic_stats(spark, d):
    return st.basic_stats(_cdx(spark, d))


@query("select coalesce(mime, '(none)') as mime, count(*) as n from cdx group by 1 order by n desc, 1 limit 20")
def mime_counts(spark, d):
    return st.mime_counts(_cdx(spark, d))


@query("select status, count(*) as n from cdx group by 1")
def status_counts(spark, d):
    return st.status_counts(_cdx(spark, d))


@query("select coalesce(collection, 'warc') as collection, count(*) as n from cdx group by 1")
def collection_counts(spark, d):
    return st.collection_counts(_cdx(spark, d))


@query(
    """select 'mime' as kind, coalesce(mime, '(none)') as key, count(*) as n from cdx group by 1, 2 union all
    select 'status', coalesce(status::varchar, '(none)'), count(*) from cdx group by 1, 2 union all select 'collection', coalesce(collection, 'warc'), count(*) from cdx group by 1, 2"""
)
def breakdowns(spark, d):
    return st.breakdowns(_cdx(spark, d))


@query("select case when collection in ('orchard-scans', 'town-gazettes') then collection else 'warc' end as collection, count(*) as n from cdx group by 1")
def collection_cards(spark, d):
    return st.collection_cards(_cdx(spark, d), ["orchard-scans", "town-gazettes"])


@query(f"select s3_key, count(*) as n from cdx where collection = 'warc' and {_INDEXABLE} group by 1")
def indexable_by_file(spark, d):
    return st.indexable_by_file(_cdx(spark, d))


@query(f"select case when contains({_HOSTED}, ',') then split_part({_HOSTED}, ',', 1) else '' end as tld, count(*) as n from cdx group by 1")
def browse_tlds(spark, d):
    return st.browse_tlds(_cdx(spark, d))


@query(f"select {_DOMAIN} as domain, count(*) as n, count(distinct surt_url) as urls from cdx group by 1")
def browse_domains(spark, d):
    return st.browse_domains(_cdx(spark, d))


@query(f"with h as (select {_HOT_DOMAIN} as d) select split_part(surt_url, ')', 1) as host, count(*) as n from cdx, h where {_HOSTED} = d or starts_with({_HOSTED}, d || ',') group by 1")
def browse_subdomains(spark, d):
    c = _cdx(spark, d)
    return st.browse_subdomains(c, hot_domain(c))


@query(
    """with t as (select s3_key, mime, count(*) n, sum(length) b, min(timestamp) f, max(timestamp) l from cdx group by 1, 2)
    select s3_key, sum(n)::bigint as captures, sum(b)::bigint as bytes, min(f) as first, max(l) as last,
    '{' || coalesce(string_agg('"' || mime || '":' || n, ',' order by mime) filter (where mime is not null), '') || '}' as mimes from t group by 1"""
)
def warc_file_stats(spark, d):
    return st.file_stats(_cdx(spark, d))


@query(
    "select " + ", ".join(f"sum({c})::bigint as {c}" for c in ("warc_records", "cdx_new", "cdx_known", "fulltext_indexed", "skipped", "errors", "size_bytes")) + ", count(*) as files from warc_files"
)
def run_totals(spark, d):
    return st.run_totals(table(spark, d, "warc_files"))


@query(
    """select '{"captures":' || count(*) || ',"urls":' || count(distinct surt_url) || ',"files":' || count(distinct s3_key) || ',"first":"' || min(timestamp) || '","last":"' || max(timestamp)
    || '","num_docs":' || (select count(*) from index_docs) || '}' as json from cdx"""
)
def api_stats(spark, d):
    return st.api_stats(_cdx(spark, d), _docs(spark, d))


# --- text -------------------------------------------------------------------------------------------------------------


@query(
    r"""with t as (select doc_id, text, regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g') as flat from documents),
    w as (select doc_id, replace(flat, ' ', '') as solid, list_filter(string_split(trim(flat, ' '), ' '), lambda x: x <> '') as tokens from t)
    select doc_id, coalesce(length(solid) >= 40 and length(regexp_replace(solid, '[^\p{L}\p{N}]', '', 'g')) >= 0.55 * length(solid)
      and len(list_filter(tokens, lambda x: length(regexp_replace(x, '\P{L}', '', 'g')) >= 2 and length(regexp_replace(x, '\P{L}', '', 'g')) * 2 >= length(x))) >= 0.4 * len(tokens), false) as good from w"""
)
def quality_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.looks_like_text(F.col("text")).alias("good"))


@query("select pdf_id, " + "replace(" * 8 + "body" + "".join(f", '{a}', '{b}')" for a, b in tx.HISTORIC) + " as body from pdf_docs")
def historic_forms(spark, d):
    return table(spark, d, "pdf_docs").select("pdf_id", tx.historic_forms(F.col("body")).alias("body"))


@query(r"select pdf_id, left(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1), '\.(?:pdf|PDF)$', ''), '_|\+|%20', ' ', 'g'), ' '), 256) as title from pdf_docs")
def title_from_url(spark, d):
    return table(spark, d, "pdf_docs").select("pdf_id", tx.title_from_url(F.col("url")).alias("title"))


@query("select rec_id, left(trim(split_part(body, chr(10), 1), ' '), 256) as title, case when contains(body, chr(10)) then substr(body, instr(body, chr(10)) + 1) else '' end as rest from index_docs")
def plain_text_parts(spark, d):
    return _docs(spark, d).select("rec_id", tx.plain_title(F.col("body")).alias("title"), tx.plain_body(F.col("body")).alias("rest"))


_PAGE = "concat('<html><head><title>', coalesce(title, ''), ' &amp; more</title><style>p {{ x: 1 }}</style></head><body><!-- <p> --><script>var a = \"<!--\";</script><p>', replace(coalesce(body, ''), chr(10), '</p><p>'), '</p></body></html>')"


def _page():
    return F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit(' &amp; more</title><style>p {{ x: 1 }}</style></head><body><!-- <p> --><script>var a = "<!--";</script><p>'), F.replace(F.coalesce("body", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
_STRIP = r"(?is)<!--.*?(?:-->|\z)|<script[>/ \t\r\n].*?(?:</script[^>]*(?:>|\z)|\z)|<style[>/ \t\r\n].*?(?:</style[^>]*(?:>|\z)|\z)|<noscript[>/ \t\r\n].*?(?:</noscript[^>]*(?:>|\z)|\z)|<[^>]*(?:>|\z)"


def _entities_sql(text: str) -> str:
    """``text`` with its entities decoded: the text between numeric references and their characters, then the named ones."""
    out = f"(select array_to_string(list_transform(regexp_split_to_array(x, '&#[0-9]{{1,9}};'), lambda s, i: s || coalesce(chr(codes[i]::int), '')), '') from (select {text} as x, regexp_extract_all({text}, '&#([0-9]{{1,9}});', 1) as codes))"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", "\xa0"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return out


@query(f"select rec_id, trim(regexp_replace({_entities_sql('t')}, '{_WS}', ' ', 'g'), ' ') as text from (select rec_id, regexp_replace({_PAGE}, '{_STRIP}', ' ', 'g') as t from index_docs)")
def html_text(spark, d):
    """Every record's text set as a page and stripped again, null as empty."""
    return _docs(spark, d).select("rec_id", tx.strip_html(_page()).alias("text"))


@query(f"select rec_id, left(trim(regexp_replace({_entities_sql('t')}, '{_WS}', ' ', 'g'), ' '), 512) as title from (select rec_id, regexp_extract({_PAGE}, '(?is)<title[^>]*>(.*?)</title', 1) as t from index_docs)")
def html_title(spark, d):
    """Every record's title, read from the same page."""
    return _docs(spark, d).select("rec_id", tx.html_title(_page()).alias("title"))


@query("select s3_key, timestamp, substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2) || '-' || substr(timestamp, 7, 2) || ' ' || substr(timestamp, 9, 2) || ':' || substr(timestamp, 11, 2) || ':' || substr(timestamp, 13, 2) as shown, epoch(strptime(timestamp, '%Y%m%d%H%M%S'))::bigint as unix from cdx")
def timestamp_forms(spark, d):
    return _cdx(spark, d).select("s3_key", "timestamp", ts.display(F.col("timestamp")).alias("shown"), ts.to_unix(F.col("timestamp")).alias("unix"))


# --- skip lists, keeping tables ---------------------------------------------------------------------------------------


#: Shapes of urls that the test tables hold: fonts, and pages of a query whose key ends in a seven.
_SKIPPED = [r"\.woff2?$", r"(?i)[?&]id=[0-9a-z]*7(?:$|&)"]


def _skip(spark, d) -> SkipList:
    c = _cdx(spark, d)
    domain = ".".join(reversed(hot_domain(c).split(",")))
    return SkipList([domain], [*_SKIPPED, "(", ""])


_SKIP_D = f"(select array_to_string(list_reverse(string_split({_HOT_DOMAIN}, ',')), '.'))"
_PATTERNS = "|".join(f"(?:{p})" for p in _SKIPPED)


def _listed_sql(col: str) -> str:
    host = f"lower(regexp_extract({col}, '://([^/:?#]*)', 1))"
    return f"((contains({col}, '://') and ({host} = d or ends_with({host}, '.' || d))) or regexp_matches({col}, '{_PATTERNS}'))"


@query(f"with h as (select {_SKIP_D} as d) select original, {_listed_sql('original')} as listed from cdx, h")
def skip_listed(spark, d):
    return _cdx(spark, d).select("original", _skip(spark, d).listed(F.col("original")).alias("listed"))


@query(
    f"""with h as (select {_SKIP_D} as d, {_HOT_DOMAIN} as k) select surt_url, timestamp, s3_key from cdx, h where not {_listed_sql('original')}
    and not (starts_with(surt_url, k || ')') or starts_with(surt_url, k || ',') or starts_with(surt_url, k || ':'))"""
)
def purge_captures(spark, d):
    return up.purge(_cdx(spark, d), _docs(spark, d), _skip(spark, d))[0].select("surt_url", "timestamp", "s3_key")


@query(f"with h as (select {_SKIP_D} as d) select rec_id, url from index_docs, h where not {_listed_sql('url')}")
def purge_docs(spark, d):
    return up.purge(_cdx(spark, d), _docs(spark, d), _skip(spark, d))[1].select("rec_id", "url")


@query("select s3_key as key, etag from warc_files f where not exists (select 1 from warc_files s where s.last_indexed < '2020' and s.s3_key = f.s3_key and s.etag = f.etag)")
def incremental_listing(spark, d):
    """All files against a state that knows those indexed before 2020."""
    files = table(spark, d, "warc_files").select(F.col("s3_key").alias("key"), "etag", "last_indexed")
    return up.new_or_changed(files.select("key", "etag"), files.filter("last_indexed < '2020'"))


_UPSERT = "row_number() over (partition by surt_url, timestamp order by {new}s3_key desc, \"offset\" desc, original desc, status desc nulls last, mime desc nulls last, digest desc nulls last, length desc, collection desc) = 1"


@query(
    "select surt_url, timestamp, s3_key, \"offset\" from (select *, case when s3_key >= 'crawl/2018' then 1 else 0 end as fresh from cdx) qualify row_number() over (partition by surt_url, timestamp order by fresh desc, s3_key desc, \"offset\" desc) = 1"
)
def upsert_captures(spark, d):
    """Captures of later crawls upserted into those of earlier ones."""
    c = _cdx(spark, d)
    rows = up.upsert(c.filter("s3_key < 'crawl/2018'"), c.filter("s3_key >= 'crawl/2018'"), ["surt_url", "timestamp"], ["s3_key", "offset"])
    return rows.select("surt_url", "timestamp", "s3_key", "offset")


@query(
    """with b as (select surt_url, timestamp, count(*) n from cdx where s3_key >= 'crawl/2018' group by 1, 2), t as (select distinct surt_url, timestamp from cdx where s3_key < 'crawl/2018')
    select count(*) filter (where t.surt_url is null) as new, (sum(n) - count(*) filter (where t.surt_url is null))::bigint as existing from b left join t using (surt_url, timestamp)"""
)
def upsert_counted(spark, d):
    c = _cdx(spark, d)
    return up.upsert_counts(c.filter("s3_key < 'crawl/2018'"), c.filter("s3_key >= 'crawl/2018'"), ["surt_url", "timestamp"])


@query("select rec_id, s3_key, '*' || coalesce(title, '') as title from index_docs where s3_key >= 'crawl/2018' union all select rec_id, s3_key, title from index_docs where s3_key < 'crawl/2018'")
def replace_on_reindex(spark, d):
    """The files of later crawls are indexed again, with marked titles."""
    docs = _docs(spark, d).select("rec_id", "s3_key", "title")
    return up.replace_files(docs, docs.filter("s3_key >= 'crawl/2018'").withColumn("title", F.concat(F.lit("*"), F.coalesce("title", F.lit("")))))


@query(f"with h as (select {_HOT_DOMAIN} as d) select surt_url, timestamp from cdx, h where not {_OF_DOMAIN}")
def delete_domain(spark, d):
    c = _cdx(spark, d)
    return up.delete_domain(c, hot_domain(c)).select("surt_url", "timestamp")


@query(
    """select s3_key, concat_ws(' ', surt_url, timestamp, coalesce(original, '-'), coalesce(mime, '-'), coalesce(status::varchar, '-'), coalesce(digest, '-'), '-', '-', coalesce(length::varchar, '-'),
    coalesce((case when ends_with(lower(s3_key), '.gz') then coalesce(c_offset, "offset") else "offset" end)::varchar, '-'), string_split(s3_key, '/')[-1]) as line from cdx"""
)
def cdx_sidecar(spark, d):
    return up.cdx_lines(_cdx(spark, d))


# --- links, joins -----------------------------------------------------------------------------------------------------


@query(
    """with c as (select distinct original as url from cdx where starts_with(lower(mime), 'application/pdf')), l as (select url from pdf_docs),
    u as (select url from c union select url from l), h as (select url from u where regexp_matches(url, '(?i)^https?://'))
    select url from h where not contains(url, '/tmp/')"""
)
def url_export(spark, d):
    """PDF URLs that were captured or are linked."""
    return ln.merged_urls(cp.pdf_urls(_cdx(spark, d)).select(F.col("original").alias("url")), table(spark, d, "pdf_docs").select("url"), F.col("url").contains("/tmp/"))


@query(
    """with c as (select distinct original as url from cdx where starts_with(lower(mime), 'application/pdf')), u as (select url from c union select url from pdf_docs)
    select (select count(*) from c) as captured, (select count(*) from pdf_docs) as linked, count(*) filter (where not regexp_matches(url, '(?i)^https?://')) as not_http,
    count(*) filter (where regexp_matches(url, '(?i)^https?://') and contains(url, '/tmp/')) as blacklisted, count(*) filter (where regexp_matches(url, '(?i)^https?://') and not contains(url, '/tmp/')) as urls from u"""
)
def url_export_report(spark, d):
    return ln.merge_report(cp.pdf_urls(_cdx(spark, d)).select(F.col("original").alias("url")), table(spark, d, "pdf_docs").select("url"), F.col("url").contains("/tmp/"))


@query(
    """select c.surt_url, c.timestamp, c.digest, case when p.digest is null then 'miss' when p.body = '' then 'negative' else 'hit' end as outcome
    from (select * from cdx where starts_with(lower(mime), 'application/pdf') and digest is not null) c left join (select digest, max(body) as body from pdf_docs where digest is not null group by 1) p using (digest)"""
)
def pdf_text_lookup(spark, d):
    """PDF captures against the cache of extracted texts; an empty text is a known failure, not a miss."""
    return ln.cache_lookup(_cdx(spark, d).filter(F.lower("mime").startswith("application/pdf") & F.col("digest").isNotNull()), table(spark, d, "pdf_docs"))


@query(
    """select f.s3_key, i.warc_date, i.block_text is not null as described, count(c.surt_url) as captures from warc_files f left join warcinfo i using (s3_key) left join cdx c using (s3_key) group by 1, 2, 3"""
)
def file_provenance(spark, d):
    n = _cdx(spark, d).groupBy("s3_key").agg(F.count("*").alias("captures"))
    info = table(spark, d, "warcinfo").select("s3_key", "warc_date", F.col("block_text").isNotNull().alias("described"))
    rows = table(spark, d, "warc_files").select("s3_key").join(info, "s3_key", "left").join(n, "s3_key", "left")
    return rows.select("s3_key", "warc_date", F.coalesce("described", F.lit(False)).alias("described"), F.coalesce("captures", F.lit(0)).alias("captures"))


# --- full-text search -------------------------------------------------------------------------------------------------


def _search(spark, d, q: str, limit: int = 50, **more) -> DataFrame:
    return ft.search(_index(spark, d), q, limit, **more)


def _index(spark, d) -> ft.Index:
    """The stored index of all documents; it is written when it is first asked for, and again when the table changes."""
    path = f"{shared_dir(spark)}/lodestrata/index-{spark.sparkContext.applicationId}-{state_of(spark, f'{d}/index_docs.parquet')}"
    if path not in _INDEXES:
        keep(spark, path)
        ft.write_index(ft.build(_docs(spark, d), "rec_id"), path)
        _INDEXES.add(path)
    return ft.read_index(spark, path)


_INDEXES: set[str] = set()


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("rank", F.col("id").alias("rec_id"), "timestamp", F.round("score", 6).alias("score"))


_FTS = r"""with tk as (select rec_id, f, list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda x: true) as ts from (select rec_id, 'title' f, coalesce(title, '') t from index_docs union all select rec_id, 'body', coalesce(body, '') from index_docs)),
ln as (select rec_id, f, len(list_filter(ts, lambda x: strlen(x) < 40)) as dl, ts from tk), av as (select f, avg(dl)::double as a, count(*)::double as n from ln group by 1),
"""


def _leaf_sql(name: str, f: str, words: list[str]) -> str:
    if len(words) == 1:
        tf = f"len(list_filter(ts, lambda x: x = '{words[0]}'))"
    else:
        same = " and ".join(f"ts[i + {j}] = '{w}'" for j, w in enumerate(words))
        tf = f"len(list_filter(range(1, len(ts) + 1), lambda i: {same}))"
    return f"""{name}_t as (select rec_id, dl, {tf}::double as tf from ln where f = '{f}'), {name}_d as (select count(*)::double as df from {name}_t where tf > 0),
{name} as (select rec_id, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / a)) as s from {name}_t, {name}_d, av where av.f = '{f}' and tf > 0)"""


def _any_sql(name: str, words: list[str]) -> str:
    return f"{_leaf_sql(name + 't', 'title', words)},\n{_leaf_sql(name + 'b', 'body', words)},\n{name} as (select rec_id, sum(s) as s from (select * from {name}t union all select * from {name}b) group by 1)"


def _top_sql(leaves: str, hits: str, where: str = "true", limit: int = 50) -> str:
    return f"""{_FTS}{leaves}, hits as ({hits}), top as (select rec_id, s, timestamp from hits join index_docs using (rec_id) where {where})
select (row_number() over (order by s desc, rec_id))::int as rank, rec_id, lpad(timestamp::varchar, 14, '0') as timestamp, round(s, 6) as score from (select * from top order by s desc, rec_id limit {limit})"""


_TWO = f"{_any_sql('x', ['museum'])},\n{_any_sql('y', ['archiv'])}"


@query(_top_sql(_TWO, "select rec_id, sum(s) as s from (select * from x union all select * from y) group by 1"))
def search_or(spark, d):
    return _shown(_search(spark, d, "museum archiv"))


@query(_top_sql(_TWO, "select rec_id, x.s + y.s as s from x join y using (rec_id)"))
def search_and(spark, d):
    return _shown(_search(spark, d, "museum AND archiv"))


@query(_top_sql(_TWO, "select rec_id, x.s as s from x where rec_id not in (select rec_id from y)"))
def search_not(spark, d):
    return _shown(_search(spark, d, "museum -archiv"))


@query(_top_sql(_any_sql("x", ["the", "museum"]), "select rec_id, s from x"))
def search_phrase(spark, d):
    return _shown(_search(spark, d, '"the museum"'))


@query(_top_sql(_leaf_sql("x", "title", ["museum"]), "select rec_id, s from x"))
def search_field(spark, d):
    return _shown(_search(spark, d, "title:museum"))


@query(_top_sql(_any_sql("x", ["museum"]), "select rec_id, s from x", "collection = 'warc'"))
def search_collection(spark, d):
    return _shown(_search(spark, d, "museum", collection="warc"))


@query(_top_sql(_any_sql("x", ["museum"]), "select rec_id, s from x", "timestamp between 20160101000000 and 20181231235959"))
def search_time_range(spark, d):
    return _shown(_search(spark, d, "museum", first=20160101000000, last=20181231235959))


@query(_top_sql("e as (select 1)", "select rec_id, 1.0::double as s from index_docs", limit=50))
def search_all(spark, d):
    return _shown(_search(spark, d, ""))


_DOM = r"""(case when regexp_matches(h, '^[0-9]+(\.[0-9]+){3}$') or not contains(h, '.') then h else array_to_string(string_split(h, '.')[-2:], '.') end)"""


@query(
    f"""with r as ({_top_sql(_any_sql('x', ['museum']), 'select rec_id, s from x', limit=200)}),
    g as (select r.*, {_DOM} as domain from (select r.*, regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '\\.$', '') as h from r join index_docs using (rec_id)) r)
    select rec_id, rank, domain, (min(rank) over (partition by domain))::int as group_rank, (row_number() over (partition by domain order by timestamp desc, rank))::int as place from g"""
)
def search_grouped(spark, d):
    hits = ft.group_by_domain(_search(spark, d, "museum", 200))
    return hits.select(F.col("id").alias("rec_id"), "rank", "domain", "group_rank", "place")


@query("select count(*) as num_docs from index_docs")
def num_docs(spark, d):
    return ft.num_docs(_docs(spark, d))
