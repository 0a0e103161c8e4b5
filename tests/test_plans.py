import pytest
from pyspark.sql import functions as F

from lodestrata.functions.skiplist import SkipList
from lodestrata.operators import fulltext as ft
from lodestrata.plans import endpoints as ep
from lodestrata.plans import maintenance as mt
from lodestrata.plans import pipeline as pl
from lodestrata.sources import warc
from test_pipeline import INFO, response

LINKS = b'<html><a href="x.pdf">1</a><a href="http://quay.invalid/y.PDF#p">2</a><a href="z.html"></html>'


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    warc.write_file(f"{folder}/one.warc.gz", [INFO, response("http://mill.test/a", LINKS), response("http://mill.test/b.pdf", b"%PDF", head=b"Content-Type: application/pdf")])
    warc.write_file(f"{folder}/two.warc", [response("http://mill.test/c", LINKS)], gz=False)
    return str(folder), pl.captures_of(pl.read_warcs(spark, str(folder))).select(*pl._KEEP).cache()


def test_export(archive):
    folder, captures = archive
    rows = mt.fetch_records(captures, folder).collect()
    assert all(r.block.startswith(b"HTTP/1.1") for r in rows) and len(rows) == 3
    assert [r.url for r in mt.export_pdf_urls(captures, folder, F.col("url").contains("nothing")).collect()] == ["http://mill.test/b.pdf", "http://mill.test/x.pdf", "http://quay.invalid/y.PDF"]
    assert mt.fetch_records(captures.withColumn("s3_key", F.lit("gone")), folder).filter("read_error is null").count() == 0


def test_files(spark, archive, tmp_path):
    _, captures = archive
    mt.write_sidecars(captures, str(tmp_path / "cdx"))
    lines = {r.s3_key: r.n for r in spark.read.text(str(tmp_path / "cdx")).groupBy("s3_key").agg(F.count("*").alias("n")).collect()}
    assert lines == {"one.warc.gz": 3, "two.warc": 2}
    assert mt.write_lines(captures, "original", str(tmp_path / "urls")) and not mt.write_lines(captures.limit(0), "original", str(tmp_path / "none"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "urls")).collect()] == sorted(r.original for r in captures.collect())


def test_extraction(spark):
    jobs = spark.createDataFrame([("a", bytearray(b"good %%EOF")), ("b", bytearray(b"cut")), ("c", bytearray(b"boom %%EOF")), ("d", None), ("e", bytearray(b"poor %%EOF"))], "digest string, content binary")

    def extract(content):
        if content.startswith(b"boom"):
            raise OSError("busy")
        return "T", "Enough readable words to pass as a text that a library would keep." if content.startswith(b"good") else "? ! ?"

    got = {r.digest: r.kind for r in mt.extract_texts(jobs, extract).collect()}
    assert got == {"a": "text", "b": "empty", "c": "transient", "d": "empty", "e": "empty"}
    objects = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, etag string")
    sidecars = spark.createDataFrame([("k", "1", "t", "x"), ("l", "1", "t", "old")], "key string, etag string, title string, text string")
    assert {r.key: r.text for r in mt.sidecar_texts(objects, sidecars).collect()} == {"k": "x", "l": None}
    assert mt.run_files(objects, "l").count() == 1 and mt.run_files(objects, max_files=1).first().key == "k"


def test_recompress(spark, archive, tmp_path):
    folder, _ = archive
    got = {r.path.rsplit("/")[-1]: r.outcome for r in mt.recompress_all(spark, [f"{folder}/one.warc.gz", f"{folder}/two.warc"], ".tmp").collect()}
    assert got == {"one.warc.gz": "per-record already", "two.warc": "rewritten"}


def test_endpoints(spark, captures):
    assert ep.lookup_capture(captures, "test,orchard)/").first().timestamp == "20210822060430"
    assert ep.lookup_capture(captures, "test,orchard)/", "2018").first().timestamp == "20180305091500"
    with pytest.raises(ep.BadRequest):
        ep.lookup_capture(captures, "test,orchard)/", "20x")
    assert ep.browse(captures).count() == 2 and ep.browse(captures, tld="test").count() == 2 and ep.browse(captures, domain="orchard.test").count() == 2
    assert ep.browse(captures, host="orchard.test").count() == 3 and ep.browse(captures, host="old.orchard.test", show_all=True).count() == 1
    rows = spark.createDataFrame([("u", "text/html", bytearray(b"<p>a")), ("v", "text/plain", bytearray(b"l1\nl2")), ("w", "image/png", bytearray(b"x")), ("x", None, None)], "original string, mime string, payload binary")
    assert {r.original: r.text for r in ep.capture_text(rows).collect()} == {"u": "a", "v": "l1\nl2", "w": None, "x": None}
    docs = spark.createDataFrame([(k, f"http://h{k}.x.org/", 20200101000000 + k, "t", "apple", "text/html", "k", k, 1, "warc") for k in range(9)], "id long, url string, timestamp long, title string, body string, mime string, s3_key string, offset long, length long, collection string")
    index = ft.build(docs, "id")
    assert ep.search(index, {"q": "apple", "limit": "3"}).count() == 3 and ep.search(index, {"q": "apple", "from": "bad"}, SkipList(["h1.x.org"])).count() == 8
    assert ep.search_page(index, {"q": "apple", "limit": 2}).filter("place = 1").count() == 1
    assert ep.rejected_patterns(SkipList([], ["a", "("])) == ["("]
