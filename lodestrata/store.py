"""Where tables lie and where intermediate results are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``. Where that is unset, a session in one process has
    an own one; a cluster's executors would not share it, so there it is an error."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def state_of(spark: SparkSession, path: str) -> str:
    """A name that changes when the table at ``path`` does: of its place, size and time of change."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = f"{path} {system.getContentSummary(where).getLength()} {system.getFileStatus(where).getModificationTime()}"
    return uuid.uuid5(uuid.NAMESPACE_URL, told).hex


def keep(spark: SparkSession, path: str) -> None:
    """Have a table deleted when the driver ends, not before."""
    if not _written and not _kept:
        atexit.register(_clean)
    _kept.append((spark, path))


_kept: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in [*_written, *_kept]:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone; the cluster's own cleaning has to do it
            return


@contextmanager
def dropped_after(spark: SparkSession):
    """Deletes, at its end, the tables that ``materialize`` wrote within: results must have been read or written by then."""
    before = len(_written)
    try:
        yield
    finally:
        for _, path in _written[before:]:
            drop_path(spark, path)
        del _written[before:]


def materialize(df: DataFrame, tag: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before them, and what is used
    twice is computed once. The table is deleted at the end of ``dropped_after``, or when the driver ends.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
