"""What must not get lost: replays of a stream, files read in part, sidecars of other runs, a shared folder."""

import pytest
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.operators import upsert as up
from lodestrata.plans import maintenance as mt
from lodestrata.plans import pipeline as pl
from lodestrata.sources import warc
from lodestrata.streaming import incremental
from test_pipeline import INFO, response

PAGE = b"<html><title>T</title><p>words</p></html>"


def test_stream_keeps_what_the_table_held(spark, captures, tmp_path):
    target, cp = f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    up.save_versioned(captures.filter("offset >= 6"), target, 4)
    captures.filter("offset < 4").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = lambda: spark.readStream.schema(captures.schema).parquet(f"{tmp_path}/in/*")
    incremental.upsert_stream(stream(), target, cp).awaitTermination(120)
    assert up.load_versioned(spark, target).count() == captures.filter("offset < 4 or offset >= 6").count() and up.last_version(spark, target) == 5
    # the batch is run again, as after a failure between the snapshot and the stream's own commit
    (commit,) = [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name == "0"]
    commit.unlink()
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    incremental.upsert_stream(stream(), target, cp).awaitTermination(120)
    assert up.load_versioned(spark, target).count() == captures.filter("offset < 4 or offset >= 6").count() and up.last_version(spark, target) == 5


def test_a_version_written_from_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert up.load_versioned(spark, path) is None
    up.save_versioned(spark.range(5), path, 0)
    up.save_versioned(up.load_versioned(spark, path).union(spark.range(2)), path, 0)
    assert up.load_versioned(spark, path).count() == 7
    for v in range(1, 6):
        up.save_versioned(spark.range(v), path, v)
    assert up.load_versioned(spark, path).count() == 5 and up.load_versioned(spark, path, before=5).count() == 4
    assert len(list((tmp_path / "t").glob("v=*"))) == 3


def test_a_file_read_in_part_keeps_its_rows(spark, tmp_path):
    a, b = response("http://mill.test/a", PAGE), response("http://mill.test/b", PAGE)
    warc.write_file(f"{tmp_path}/x.warc", [INFO, a, b], gz=False)
    records = lambda: pl.read_warcs(spark, f"{tmp_path}/x.warc")
    found = pl.captures_of(records())
    captures, docs, out = pl.index_run(records(), found.select(*pl._KEEP).limit(0), pl.documents_of(found).limit(0))
    captures, docs = spark.createDataFrame(captures.collect(), captures.schema), spark.createDataFrame(docs.collect(), docs.schema)
    assert captures.count() == docs.count() == 2 and out.first().outcome == "done"
    with open(f"{tmp_path}/x.warc", "wb") as f:
        f.write(INFO + a + b"NONSENSE" + b)
    again, docs_again, out = pl.index_run(records(), captures, docs)
    assert again.count() == docs_again.count() == 2 and out.first().outcome == "partial"
    warc.write_file(f"{tmp_path}/x.warc", [INFO], gz=False)
    none, no_docs, out = pl.index_run(records(), captures, docs)
    assert none.count() == no_docs.count() == 0 and out.first().outcome == "done"


def test_sidecars_of_other_files_stay(captures, spark, tmp_path):
    folder = str(tmp_path / "cdx")
    mt.write_sidecars(captures.filter("s3_key = 'a.warc.gz'"), folder)
    mt.write_sidecars(captures, folder, captures.filter("s3_key = 'a.warc.gz'").select("s3_key").distinct())
    got = {r.s3_key for r in spark.read.text(folder).select("s3_key").distinct().collect()}
    assert got == {"a.warc.gz", "b.warc.gz"}


def test_shared_folder(spark):
    with store.dropped_after(spark):
        kept = store.materialize(spark.range(3))
        assert kept.count() == 3 and store._written
    with pytest.raises(Exception):
        kept.select(F.sum("id")).collect()

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        store.shared_dir(Session())
