"""Keeping tables: incremental listing, upserts, deletion, replace on re-index. Tables are whole snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.skiplist import SkipList
from lodestrata.operators.captures import of_domain
from lodestrata.store import drop_path


def new_or_changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Objects whose (key, etag) isn't in the state; without an etag on either side an object is always taken."""
    return listing.join(state.select("key", "etag"), ["key", "etag"], "left_anti")


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order. A key's rows are reduced before the shuffle, so no key is too large."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("b"))
    return best.select("b.*")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The batch's last row for each key replaces the target's."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_by(rows, keys, ["_new", *order]).drop("_new")


def upsert_counts(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """(new, existing): the first row of a key that the target lacks is new, all others exist."""
    own = batch.groupBy(*keys).agg(F.count("*").alias("rows"))
    known = own.join(target.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    counts = known.agg(F.count_if(F.col("known").isNull()).alias("new"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return counts.select("new", (F.col("rows") - F.col("new")).alias("existing"))


def upsert_files(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Files by s3_key: everything is overwritten but first_seen, which the earlier row keeps."""
    old = target.select("s3_key", F.col("first_seen").alias("_seen"))
    kept = target.join(batch.select("s3_key"), "s3_key", "left_anti")
    return kept.unionByName(batch.join(old, "s3_key", "left").withColumn("first_seen", F.coalesce("_seen", "first_seen")).drop("_seen"), allowMissingColumns=True)


def delete_file(captures: DataFrame, s3_key: str) -> DataFrame:
    return captures.filter(~F.col("s3_key").eqNullSafe(s3_key))


def delete_domain(captures: DataFrame, domain_surt: str) -> DataFrame:
    return captures.filter(~F.coalesce(of_domain(F.col("surt_url"), domain_surt), F.lit(False)))


def delete_surts(captures: DataFrame, surts: DataFrame) -> DataFrame:
    return captures.join(surts.select("surt_url").distinct(), "surt_url", "left_anti")


def replace_files(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace on re-index: all rows of the batch's files go, the batch comes; other files' rows of the same URLs stay."""
    return without_files(docs, batch.select("s3_key")).unionByName(batch, allowMissingColumns=True)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("s3_key").distinct(), "s3_key", "left_anti")


def purge(captures: DataFrame, docs: DataFrame, skip: SkipList) -> tuple[DataFrame, DataFrame]:
    """Captures and documents without what the skip list names; both by predicate, so http and https twins go alike."""
    kept = captures.filter(~(F.coalesce(skip.surt_listed(F.col("surt_url")), F.lit(False)) | skip.listed(F.col("original"))))
    return kept, docs.filter(~skip.listed(F.col("url")))


def cdx_lines(captures: DataFrame) -> DataFrame:
    """(s3_key, line): the 11 fields of a file's index, space-joined, null as a dash; the header comes with ``CDX_HEADER``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    place = F.when(F.lower("s3_key").endswith(".gz"), F.coalesce("c_offset", "offset")).otherwise(F.col("offset"))
    line = F.concat_ws(" ", part("surt_url"), part("timestamp"), part("original"), part("mime"), part("status"), part("digest"), F.lit("-"), F.lit("-"), part("length"), F.coalesce(place.cast("string"), F.lit("-")), F.substring_index("s3_key", "/", -1))
    return captures.select("s3_key", line.alias("line"))


CDX_HEADER = " CDX N b a m s k r M S V g"


def save_versioned(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write a snapshot beside the earlier ones, then name it the current one; readers of older ones go on.

    A snapshot's folder is never written twice: when a version is written again after a failure, also from its own earlier
    snapshot, it goes to a new folder, and only then does the pointer change.
    """
    spark = df.sparkSession
    name = f"v={version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    pointer = f"{path}/current-{version}-{name.partition('-')[2]}"
    spark.createDataFrame([(version, name, time.time_ns())], "version long, name string, at long").coalesce(1).write.json(pointer)
    for old_version, old_name, _ in sorted(_snapshots(spark, path), reverse=True)[keep + 1 :]:
        drop_path(spark, f"{path}/current-{old_version}-{old_name.partition('-')[2]}")
        drop_path(spark, f"{path}/{old_name}")


def _exists(spark: SparkSession, pattern: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _snapshots(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """The few snapshots that are kept: version, folder and when it was named; no error but a missing table means none."""
    if not _exists(spark, f"{path}/current-*/_SUCCESS"):
        return []
    rows = spark.read.schema("version long, name string, at long").json(f"{path}/current-*").collect()
    return [(r.version, r.name, r.at) for r in rows if r.name]


def load_versioned(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The current snapshot, or the last one of a version less than ``before``; None if there is none yet."""
    known = [(v, at, name) for v, name, at in _snapshots(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/{max(known)[2]}") if known else None


def last_version(spark: SparkSession, path: str) -> int:
    """The current version's number, -1 if there is none."""
    return max((v for v, _, _ in _snapshots(spark, path)), default=-1)
