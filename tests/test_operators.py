import pytest
from pyspark.sql import functions as F

from lodestrata.functions.skiplist import SkipList
from lodestrata.operators import captures as cp
from lodestrata.operators import fulltext as ft
from lodestrata.operators import links as ln
from lodestrata.operators import statistics as st
from lodestrata.operators import upsert as up
from lodestrata.operators.components import components
from lodestrata.plans import config


def test_closest(captures):
    at = lambda t, **k: [r.timestamp for r in cp.closest(captures, "test,orchard)/", t, **k).collect()]
    assert at("20191117201010") == ["20191117201010"] and at("20100101000000") == ["20180305091500"] and at("20300101000000") == ["20210822060430"]
    assert at("not a time") == [] and cp.closest(captures, "no,such)/", "20191117201010").count() == 0
    tie = captures.filter("surt_url = 'test,orchard)/pears'")
    assert cp.closest(tie, "test,orchard)/pears", "20200214101010").first().timestamp == "20200214070809"


def test_closest_metric(spark):
    rows = spark.createDataFrame([("x)/", "20240131000000", "k", 0, 200), ("x)/", "20240201000000", "k", 1, 200)], "surt_url string, timestamp string, s3_key string, offset bigint, status int")
    probe = spark.createDataFrame([(1, "x)/", "20240131235959", "clash"), (2, None, "2024", "clash")], "probe_id int, surt_url string, at string, distance string")
    assert cp.closest_each(probe, rows).first().timestamp == "20240131000000"
    assert cp.closest_each(probe, rows, "seconds").first().timestamp == "20240201000000"
    assert cp.closest_each(probe, rows.limit(0)).count() == 0


def test_lookups(captures):
    assert [r.timestamp for r in cp.by_prefix(captures, "test,orchard)", 2).collect()] == ["20180305091500", "20191117201010"]
    assert cp.by_prefix(captures, "").count() == 0
    assert {r[0] for r in cp.originals_of_domain(captures, "test,orchard").collect()} == {"https://orchard.test/", "https://ORCHARD.test/", "https://orchard.test/pears", "https://old.orchard.test/x"}
    assert cp.pdf_urls(captures).count() == 1
    assert cp.cdx_lookup(captures, "test,orchard,old)/x").first().mime == "-"
    assert cp.cdx_lookup(captures, "test,orchard)/pears", "prefix", limit=3).count() == 3
    assert cp.timemap(captures, "test,orchard)/", -1).first().line.split()[1] == "20210822060430"
    runs = cp.browse_captures(captures, True).filter("surt_url = 'test,orchard)/'").orderBy("run").collect()
    assert [(r.captures, r.ok) for r in runs] == [(2, True), (1, True)]
    assert cp.by_surt_range(captures, "test,orchard)/", "20191117201010", "20210822060430").count() == 2


def test_statistics(captures):
    s = st.basic_stats(captures).first()
    assert (s.captures, s.urls, s.files, s.first, s.last) == (8, 5, 2, "20180305091500", "20210822060430")
    none = st.basic_stats(captures.limit(0)).first()
    assert none.captures == 0 and none.first is None
    assert st.mime_counts(captures).collect()[0].mime == "text/html"
    assert {(r.host, r.n) for r in st.browse_subdomains(captures, "test,orchard").collect()} == {("test,orchard", 5), ("test,orchard,old", 1)}
    assert [(r.collection, r.n) for r in st.collection_cards(captures, ["scans"]).collect()] == [("warc", 7), ("scans", 1)]
    assert st.collection_cards(captures, ["none"]).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "k1", 0), ("b", "1", "k1", 1)], "surt_url string, timestamp string, s3_key string, offset bigint")
    new = spark.createDataFrame([("a", "1", "k2", 0), ("a", "1", "k2", 5), ("c", "1", "k2", 2), ("c", "1", "k2", 3)], old.schema)
    got = {r.surt_url: (r.s3_key, r.offset) for r in up.upsert(old, new, ["surt_url", "timestamp"], ["s3_key", "offset"]).collect()}
    assert got == {"a": ("k2", 5), "b": ("k1", 1), "c": ("k2", 3)}
    assert tuple(up.upsert_counts(old, new, ["surt_url", "timestamp"]).first()) == (1, 3)
    assert tuple(up.upsert_counts(old, new.limit(0), ["surt_url", "timestamp"]).first()) == (0, 0)
    assert {r.s3_key for r in up.delete_file(old.union(new), "k1").collect()} == {"k2"}
    files = spark.createDataFrame([("k", "2020", 1)], "s3_key string, first_seen string, n int")
    assert tuple(up.upsert_files(files, spark.createDataFrame([("k", "2024", 2), ("l", "2024", 3)], files.schema)).orderBy("s3_key").first()) == ("k", "2020", 2)


def test_incremental(spark):
    state = spark.createDataFrame([("a", "1"), ("b", None)], "key string, etag string")
    listing = spark.createDataFrame([("a", "1"), ("a2", "1"), ("b", None), ("c", "2")], state.schema)
    assert {r.key for r in up.new_or_changed(listing, state).collect()} == {"a2", "b", "c"}


def test_versioned(spark, tmp_path):
    for v in range(3):
        up.save_versioned(spark.range(v + 1), f"file://{tmp_path}/t", v)
    assert up.load_versioned(spark, f"file://{tmp_path}/t").count() == 3


def test_purge_and_export(spark, captures):
    docs = spark.createDataFrame([("http://orchard.test/",), ("https://ledger.invalid/",)], "url string")
    kept, left = up.purge(captures, docs, SkipList(["orchard.test"]))
    assert kept.count() == 2 and left.count() == 1
    a = spark.createDataFrame([("http://x/1.pdf",), ("ftp://x/",)], "url string")
    b = spark.createDataFrame([("http://x/1.pdf",), ("http://x/1.pdf",), ("http://bad/2.pdf",), (None,)], "url string")
    bad = F.col("url").contains("bad")
    assert tuple(ln.merge_report(a, b, bad).first()) == (2, 3, 1, 1, 1) and ln.merged_urls(a, b, bad).count() == 1
    line = up.cdx_lines(captures).filter("line like 'test,orchard,old%'").first().line
    assert line.split()[3:6] == ["-", "-", "-"] and line.endswith(" a.warc.gz")


def test_queue(spark):
    queue = spark.createDataFrame([("d1", 0, 1), ("d2", 2, 1), ("d3", 0, 1)], "digest string, attempts int, enqueued int")
    assert ln.enqueue(queue, spark.createDataFrame([("d1", 0, 2)], queue.schema)).filter("digest = 'd1'").first().enqueued == 2
    out = spark.createDataFrame([("d1", "text", "x"), ("d2", "transient", None)], "digest string, kind string, text string")
    again, texts, failed = ln.settle(queue, out)
    assert [r.digest for r in again.collect()] == ["d3"] and texts.first().body == "x" and failed.first().digest == "d2"


def test_query_language():
    assert ft.parse("  ") is None
    tree = ft.parse("a AND b OR -c")
    assert len(tree.should) == 1 and len(tree.without) == 1 and len(tree.should[0].must) == 2
    assert ft.parse("title:Ab").should[0] == ft.Leaf("title", ("ab",))
    for bad in ("-a", "NOT a", "timestamp:1", "(a", "a)", "AND a", '"--"'):
        with pytest.raises(ft.QueryError):
            ft.parse(bad)


def test_search(spark):
    rows = [
        (1, "http://a.x.org/", 20200101000000, "red apple", "an apple a day", "text/html", "k", 0, 1, "warc"),
        (2, "http://b.x.org/", 20210101000000, "pear", "apple and pear", "text/html", "k", 1, 1, "warc"),
        (3, "http://y.org/", 20220101000000, None, "pear apple", "text/plain", "k", 2, 1, "scans"),
        (4, "http://z.org/", 20220101000000, "", None, None, "k", 3, 1, "scans"),
    ]
    docs = spark.createDataFrame(rows, "id long, url string, timestamp long, title string, body string, mime string, s3_key string, offset long, length long, collection string")
    index = ft.build(docs, "id")
    ids = lambda q, **k: [r.id for r in ft.search(index, q, **k).collect()]
    assert ids("apple")[0] == 1 and set(ids("apple")) == {1, 2, 3} and ids("apple AND pear") and set(ids("apple -day")) == {2, 3}
    assert ids('"apple and pear"') == [2] and ids('"pear apple"') == [3] and ids("title:pear") == [2] and ids("mime:text/plain") == [3]
    assert set(ids("+apple day")) == {1, 2, 3} and ids("apple", collection="scans") == [3] and ids("apple", last=20205) == [] and ids("apple", limit=0) == []
    assert set(ids("")) == {1, 2, 3, 4} and ids("missing") == [] and ids("(red OR missing) AND apple") == [1]
    groups = ft.group_by_domain(ft.search(index, "apple")).filter("domain = 'x.org'").orderBy("place").collect()
    assert [r.id for r in groups] == [2, 1]
    assert ft.schema_compat(["a"], ["a", "b"]) == "behind" and ft.schema_compat(["b"], ["a"]) == "incompatible"


def test_index_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u", 1, "t", "some body", "text/html", "k", 0, 1, "warc")], "id long, url string, timestamp long, title string, body string, mime string, s3_key string, offset long, length long, collection string")
    ft.write_index(ft.build(docs, "id"), str(tmp_path))
    assert ft.search(ft.read_index(spark, str(tmp_path)), "body:body").first().id == 1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(100, k) for k in range(101, 140)], "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got[3] == got[1] == 1 and got[5] == 4 and got[139] == 100 and 7 not in got
    assert components(links.limit(0), "a", "b").count() == 0


def test_config():
    c = config.load({"bucket": "b", "ocr": {"workers": 5}}, {"LODESTRATA_MAX_RESULTS": "7", "LODESTRATA_OCR_URL": "http://o"})
    assert (c.bucket, c.max_results, c.ocr.workers, c.ocr.url) == ("b", 7, 5, "http://o")
    with pytest.raises(KeyError):
        config.load({"nope": 1}, {})
    with pytest.raises(ValueError):
        config.load({}, {"LODESTRATA_MAX_RESULTS": "x"})
    assert config.with_override(c.ocr, {"workers": 1, "url": "http://p"}).url == "http://o" and config.with_override(c.ocr, {"url": "http://p"}, True).url == "http://p"
