import pytest

from lodestrata.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(cores=4, app="tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


CAPTURES = (
    "surt_url string, timestamp string, original string, mime string, status int, digest string, s3_key string, offset bigint, length bigint, c_offset bigint, collection string"
)


@pytest.fixture(scope="session")
def captures(spark):
    def row(surt, ts, original, mime="text/html", status=200, key="a.warc.gz", offset=0, collection="warc", digest="sha1:X"):
        return (surt, ts, original, mime, status, digest, key, offset, 512, offset // 2, collection)

    rows = [
        row("test,orchard)/", "20180305091500", "https://orchard.test/", offset=1),
        row("test,orchard)/", "20191117201010", "https://orchard.test/", offset=2, status=404),
        row("test,orchard)/", "20210822060430", "https://ORCHARD.test/", offset=3),
        row("test,orchard)/pears", "20200214070809", "https://orchard.test/pears", offset=4),
        row("test,orchard)/pears", "20200214181920", "https://orchard.test/pears", offset=5, key="b.warc.gz"),
        row("test,orchard,old)/x", "20200214181920", "https://old.orchard.test/x", mime=None, status=None, digest=None, offset=6),
        row("test,orchardist)/", "20200214181920", "https://orchardist.test/", offset=7),
        row("invalid,ledger)/a.pdf", "20190730235959", "https://ledger.invalid/a.pdf", mime="application/pdf; charset=binary", offset=8, collection="scans"),
    ]
    return spark.createDataFrame(rows, CAPTURES)
