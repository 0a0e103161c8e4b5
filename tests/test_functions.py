import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import http
from lodestrata.functions import text as tx
from lodestrata.functions import timestamps as ts
from lodestrata.functions import urls as ur
from lodestrata.functions.skiplist import SkipList, compile_patterns, load_domains, load_patterns


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_surt(spark):
    pairs = {
        "https://www.Example.com/a?b=1#c": "com,example,www)/a?b=1",
        "http://example.com": "com,example)/",
        "http://example.com:80/x": "com,example)/x",
        "https://example.com:8443/x": "com,example):8443/x",
        "http://u:p@example.com./": "com,example)/",
        "http://192.168.0.1/": "1,0,168,192)/",
        "http://example.com?q": "com,example)/?q",
        "not a url": None,
        "": None,
        None: None,
    }
    assert each(spark, list(pairs), ur.to_surt) == list(pairs.values())


def test_url_parts(spark):
    assert each(spark, ["https://a.b.example.com:81/x", "http://1.2.3.4/", "localhost", "http://[::1]:80/", "http://u@x.org./"], ur.url_domain) == ["example.com", "1.2.3.4", "localhost", "[::1]", "x.org"]
    assert each(spark, ["dns:x", "DNS:", "urn:X-wpull:log", "http://dns:"], ur.is_bookkeeping_url) == [True, False, True, False]
    assert each(spark, ["a b~c/ü*"], ur.percent_encode) == ["a%20b~c%2F%C3%BC%2A"]
    assert each(spark, ["com,example,www"], ur.surt_to_domain) == ["www.example.com"]
    assert each(spark, ["Www.Example.com"], ur.domain_to_surt_prefix) == ["com,example,www)"]
    assert each(spark, ["bytes 0-9/100", "x"], ur.content_range) == [(0, 9, 100), (None, None, None)]
    assert each(spark, ["example.com/x", "ftp://y"], ur.with_scheme) == ["http://example.com/x", "ftp://y"]
    assert each(spark, ["HTTP://Example.com/p?b=2&a=1#f", None], ur.canonicalize) == ["http://example.com/p?a=1&b=2", None]
    assert ur.next_prefix("com,a)") == "com,a*" and ur.next_prefix("") == ""


def test_timestamps(spark):
    assert each(spark, ["20240229120000", "20230229120000", "2024", None], ts.is_valid) == [True, False, False, False]
    assert each(spark, ["2024", "202406", "20240601123456789"], ts.pad) == ["20240101000000", "20240601000000", "20240601123456"]
    assert each(spark, ["20240102030405", "x"], ts.display) == ["2024-01-02 03:04:05", "x"]
    assert each(spark, ["2024-01-02T03:04:05Z", "?"], ts.from_iso) == ["20240102030405", "0" * 14]
    assert ts.day_bounds("20240101", "20240102") == ("20240101000000", "20240102235959") and ts.day_bounds("x", None) == (None, None)


def test_html(spark):
    pages = [
        "<p>a</p>b", "<script>a='<!--';</script>text<!-- c -->end", "<scriptural>x</scriptural>", "a<b", "x &amp;lt; &#228; &#x41; &copy; &nbsp; y", "<title>T &amp; U</title><noscript>n</noscript>z", "", None,
    ]
    assert each(spark, pages, tx.strip_html) == ["a b", "text end", "x", "a", "x &lt; ä A &copy; y", "T & U z", "", None]
    assert each(spark, ["<TITLE a=1> x\n y </title>", "none"], tx.html_title) == ["x y", ""]
    assert tx.decode_entities("&#99999999999;&bogus;&") == "&#99999999999;&bogus;&"
    links = tx.links_of("http://x.org/d/", "<a href='a.pdf'>1</a><!-- <a href=b> --><A HREF=\"/c.PDF#p\"><a data-href=no><a href=mailto:x><script><a href=s></script><a href=//y.org/z>")
    assert links == ["http://x.org/d/a.pdf", "http://x.org/c.PDF", "http://y.org/z"]
    assert tx.links_of("http://x.org/", "<a href=q.pdf?x=1><a href=r.html>", True) == ["http://x.org/q.pdf?x=1"]


def test_pdf_text(spark):
    assert each(spark, ["Waſſer ﬁne ﬆ"], tx.historic_forms) == ["Wasser fine st"]
    assert each(spark, ["This is a readable line of text with more than forty characters.", "0 1 2 . , ; - " * 9, "short", "", None], tx.looks_like_text) == [True, False, False, False, False]
    assert each(spark, ["http://x/a_b+c%20d.pdf?q", "http://x/dir/"], tx.title_from_url) == ["a b c d", "dir"]
    assert tx.xhtml_to_text('<div class="page"><p>a  b</p></div><div class="page"></div><div class="page"><p>c</p></div>') == "a b\f\fc"
    assert tx.parse_rmeta(json.dumps([{"dc:title": ["T"], "X-TIKA:content": "<p>x</p>"}, {"X-TIKA:content": "y"}])) == ("T", "x\ny\n")
    assert each(spark, ["ab€c"], lambda c: tx.truncate_bytes(c, 4)) == ["ab"]
    assert each(spark, ["  a   b \n\n\n\nc\fd"], tx.normalize_page_space) == ["a b\n\nc\fd"]


def chunked(*parts):
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def test_http(spark):
    import gzip
    import zlib

    block = lambda head, body: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    p = http.parse_block(block(b"Content-Type: text/html\r\nContent-Encoding: GZIP\r\nX: 1", chunked(gzip.compress(b"hello"))))
    assert (p.status, p.content_type, p.content_encoding) == (200, "text/html", "gzip") and http.payload(p) == b"hello"
    assert http.payload(http.parse_block(block(b"Content-Encoding: deflate", zlib.compress(b"x")[2:-4]))) == b"x"
    assert http.payload(http.parse_block(block(b"Content-Encoding: gzip", b"plain after all"))) == b"plain after all"
    with pytest.raises(http.Undecodable):
        http.payload(http.parse_block(block(b"Content-Encoding: gzip", b"\0\1binary")))
    with pytest.raises(http.Undecodable):
        http.payload(http.parse_block(block(b"Content-Encoding: br", b"x")))
    assert http.payload(http.parse_block(block(b"Content-Encoding: gzip", gzip.compress(b"a" * 50000)[:-20]))).startswith(b"aaa")
    assert http.dechunk(b"5\r\nab") == b"ab" and http.dechunk(b"zz") is None and http.dechunk(b"2;x=1\r\nab\r\n0\r\n\r\n") == b"ab" and http.dechunk(b"2\r\nabc") is None
    assert http.parse_block(b"no blank line").body == b"no blank line"
    assert http.status_of(b"HTTP/1.1 abc") is None and http.content_type_of(b"HTTP/1.1 200\r\nContent-Type:\r\ncontent-type: a/b\r\n\r\n") == "a/b"
    assert http.wire_class(http.parse_block(block(b"A: b", chunked(b"x"))), False) == "chunked" and http.wire_class(http.parse_block(block(b"A: b", chunked(b"x"))), True) == "encoded"
    rows = spark.createDataFrame([(bytearray(block(b"Content-Type: a/b", b"z")),), (None,)], "b binary").select(http.http_parts("b").alias("p")).collect()
    assert rows[0].p.payload == b"z" and rows[0].p.status == 200 and rows[1].p.payload is None


def test_skip_list(spark):
    assert load_domains("A.com # c\n\n# x\n*.b.org\na.com") == ["a.com", "b.org"] and load_patterns("# no\n a \nb") == ["a", "b"]
    assert compile_patterns(["a", "(", "", "b*"]) == (["a"], ["(", "", "b*"])
    skip = SkipList(["bad.com"], [r"(?i)/PRIVATE/", "("])
    urls = ["http://bad.com/", "http://x.BAD.com:80/", "http://notbad.com/", "http://ok.org/private/x", "bad.com", None]
    assert each(spark, urls, skip.listed) == [True, True, False, True, False, False]
    assert each(spark, ["com,bad)/", "com,bad,x)/", "com,badx)/"], skip.surt_listed) == [True, True, False]
    assert len(skip.crawler_lines()) == 2 and skip.rejected == ["("]
    assert each(spark, ["http://x/"], SkipList().listed) == [False]
