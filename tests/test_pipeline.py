import gzip
import os

import pytest

from lodestrata.plans import pipeline as pl
from lodestrata.sources import objects, warc
from lodestrata.streaming import incremental


def response(url, body, date="2019-05-06T07:08:09Z", head=b"Content-Type: text/html; charset=utf-8", extra=()):
    return warc.record_bytes("response", [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:{url}>"), ("WARC-Payload-Digest", "sha1:P"), ("Content-Type", "application/http; msgtype=response"), *extra], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)


INFO = warc.record_bytes("warcinfo", [("WARC-Date", "2019-05-06T00:00:00Z"), ("WARC-Record-ID", "<urn:i>")], b"software: x\r\n")
PAGE = b"<html><title>Hi &amp; bye</title><body><p>Some text</p></body></html>"


@pytest.fixture()
def folder(tmp_path):
    chunks = b"5\r\n" + gzip.compress(PAGE)[:5] + b"\r\n%x\r\n" % (len(gzip.compress(PAGE)) - 5) + gzip.compress(PAGE)[5:] + b"\r\n0\r\n\r\n"
    records = [
        INFO,
        response("http://mill.test/a", PAGE),
        response("http://mill.test/b", chunks, head=b"Content-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip"),
        response("http://mill.test/t", b"First line\nrest of it", head=b"Content-Type: text/plain"),
        response("dns:mill.test", b"x"),
        warc.record_bytes("request", [("WARC-Target-URI", "http://mill.test/a"), ("WARC-Date", "2019-05-06T07:08:09Z")], b"GET / HTTP/1.1\r\n\r\n"),
        response("http://mill.test/a", PAGE, date="not a date"),
    ]
    warc.write_file(f"{tmp_path}/one.warc.gz", records)
    warc.write_file(f"{tmp_path}/two.warc", [b"\r\n\r\n" + records[0], records[1]], gz=False)
    with open(f"{tmp_path}/bad.warc", "wb") as f:
        f.write(records[1] + b"NONSENSE")
    return tmp_path


def test_reader(spark, folder):
    rows = pl.read_warcs(spark, str(folder)).collect()
    assert len([r for r in rows if r.s3_key == "one.warc.gz" and not r.error]) == 7
    assert [r.error is None for r in rows if r.s3_key == "bad.warc"] == [True, False]
    for r in rows:
        if not r.error and r.s3_key != "two.warc":
            assert warc.read_at(f"{folder}/{r.s3_key}", r.offset, r.c_offset) == r.block
    with pytest.raises(Exception):
        pl.read_warcs(spark, f"{folder}/bad.warc", "FAILFAST").collect()


def test_headers(tmp_path):
    raw = b"WARC/1.0\r\nWARC-Type: Resource\r\nX-Long: a\r\n  b\r\nWARC-Concurrent-To: <1>\r\nWARC-Concurrent-To: <2>\r\nWARC-Target-URI: http://x:80/a:b\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    (tmp_path / "h.warc").write_bytes(raw)
    (row,) = warc.read_file(f"{tmp_path}/h.warc", "h.warc")
    assert row[4] == "resource" and row[7] == "http://x:80/a:b" and row[15] == ["<1>", "<2>"] and ("x-long", "a b") in row[18]


@pytest.mark.parametrize("raw", [b"WARC/1.0\r\nA: b\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.0\r\nContent-Length: 1\r\n\r\nzNO", b"HTTP/1.1\r\n\r\n", b"WARC/1.0\r\nno colon\r\n\r\n"])
def test_broken(tmp_path, raw):
    (tmp_path / "b.warc").write_bytes(raw)
    (row,) = warc.read_file(f"{tmp_path}/b.warc", "b.warc")
    assert row[-1]


def test_index_run(spark, folder):
    records = pl.read_warcs(spark, f"{folder}/one.warc.gz")
    found = pl.captures_of(records)
    assert {r.original for r in found.collect()} == {"http://mill.test/a", "http://mill.test/b", "http://mill.test/t"}
    docs = {r.url: r for r in pl.documents_of(found).collect()}
    assert docs["http://mill.test/b"].body == "Hi & bye Some text" and docs["http://mill.test/b"].title == "Hi & bye"
    assert (docs["http://mill.test/t"].title, docs["http://mill.test/t"].body) == ("First line", "rest of it")
    assert pl.warcinfo_of(records).first().block_text == "software: x\r\n"
    c0, d0 = found.select(*pl._KEEP).limit(0), pl.documents_of(found).limit(0)
    c1, d1, out = pl.index_run(records, c0, d0)
    c2, d2, _ = pl.index_run(records, c1, d1)
    assert c1.count() == c2.count() == 3 and d1.count() == d2.count() == 3 and out.first().outcome == "done"
    listing = spark.createDataFrame([("one.warc.gz", "e")], "key string, etag string")
    state = pl.new_state(listing.limit(0), listing, out)
    assert pl.pending(listing, state).count() == 0
    bad = pl.outcomes_of(pl.read_warcs(spark, f"{folder}/bad.warc"))
    assert bad.first().outcome == "partial"
    cache = spark.createDataFrame([("sha1:P", "", "This is a readable line of text with more than forty characters.")], "digest string, title string, body string")
    assert pl.pdf_documents(found.withColumn("mime", pl.F.lit("application/pdf")), cache).count() == 3


def test_wire_scan(spark, folder):
    found = pl.captures_of(pl.read_warcs(spark, f"{folder}/one.warc.gz")).select(*pl._KEEP)
    r = pl.wire_scan(found, str(folder), 4).first()
    assert (r.indexable, r.sampled, r.damaged, r.estimate, r.needs_reindex) == (3, 3, 1, 1, True)


def test_recompress(folder, tmp_path):
    got = warc.recompress(f"{folder}/two.warc", f"{tmp_path}/new.warc.gz")
    assert got["outcome"] == "rewritten" and got["records"] == 2
    assert warc.recompress(f"{folder}/one.warc.gz", f"{tmp_path}/x.gz")["outcome"] == "per-record already"
    assert warc.recompress(f"{folder}/bad.warc", f"{tmp_path}/y.gz")["outcome"] == "failed" and not os.path.exists(f"{tmp_path}/y.gz")
    assert warc.recompress(f"{folder}/bad.warc", f"{tmp_path}/y.gz", salvage=True)["records"] == 1


def test_listing(spark, folder):
    (folder / "doc.PDF").write_bytes(b"%PDF")
    rows = objects.listing(spark, f"file://{folder}")
    assert {r.key for r in rows.collect()} == {"one.warc.gz", "two.warc", "bad.warc", "doc.PDF"}
    pdf = objects.pdf_collection(rows, "scans", "https://scans.quay.invalid/").first()
    assert pdf.surt_url == "invalid,quay,scans)/doc.PDF" and pdf.length == 4 and pdf.collection == "scans"
    assert objects.pdf_collection(rows, "scans", "https://x", "^never").count() == 0


def test_streaming(spark, captures, tmp_path):
    for k, part in enumerate((captures.filter("offset < 4"), captures.filter("offset >= 3"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = incremental.upsert_stream(stream, f"file://{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    from lodestrata.operators.upsert import load_versioned

    assert load_versioned(spark, f"file://{tmp_path}/out").count() == captures.count()
    assert incremental.counts_by_hour(captures).count() > 0
