"""A streaming front end of the index: captures that arrive as Parquet files, upserted batch by batch.

The file source knows files by path and won't read one again that changes in place; changes are found by the state of
etags (``operators.upsert.new_or_changed``), which stays the source of truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.upsert import last_version, load_versioned, save_versioned, upsert

KEYS, ORDER = ["surt_url", "timestamp"], ["s3_key", "offset"]


def arriving(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(captures: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Upsert every batch into the versioned table at ``target``, which may hold rows already.

    The versions of a run follow those the table had when its checkpoint was new (kept beside the checkpoint), so a batch
    that is run again after a failure starts from the snapshot before it and replaces its own. A failing read ends the
    query; it never counts as an empty table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if load_versioned(spark, start) is None:
            save_versioned(spark.createDataFrame([(last_version(spark, target) + 1,)], "first long"), start, 0)
        version = load_versioned(spark, start).first()[0] + number
        now = load_versioned(spark, target, before=version)
        save_versioned(upsert(batch.limit(0) if now is None else now, batch, KEYS, ORDER), target, version)

    start = f"{checkpoint.rstrip('/')}-start"

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Captures by hour and status class, late ones up to ``delay``."""
    at = F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))
    rows = events.withColumn("at", at).filter("at is not null").withWatermark("at", delay)
    return rows.groupBy(F.window("at", "1 hour").alias("hour"), F.floor(F.col("status") / 100).alias("class")).agg(F.count("*").alias("n"))
