"""Pieces shared by the corpus operators: written intermediate tables and text sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import session

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts in an Arrow batch. Executors and Python workers hold a few batches each.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, and cut Arrow batches to BATCH_ROWS where the session has Spark's own number."""
    session.ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (``local[...]``, as in tests) and without the setting a temporary folder stands in,
    one an application, which goes when the process ends. A cluster must name its folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_docloom_dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = spark.sparkContext._docloom_dir = f"file://{folder}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has been written to; :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._docloom_paths = [*getattr(spark.sparkContext, "_docloom_paths", ()), path]
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and lets several branches of a plan
    read a computed table without computing it again. The files belong to the returned DataFrame and
    stay until the application's folder is removed with :func:`release`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing will read again; other tables have none."""
    if path := getattr(df, "_docloom_path", None):
        _forget(df.sparkSession, [path])


def written(spark: SparkSession) -> int:
    """How many intermediate tables are there: a mark for :func:`release`."""
    return len(getattr(spark.sparkContext, "_docloom_paths", ()))


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the intermediate tables that this application has written since a mark, except one that is still read."""
    spare = getattr(but, "_docloom_path", None)
    _forget(spark, [p for p in getattr(spark.sparkContext, "_docloom_paths", ())[since:] if p != spare])


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete(spark, path)
    spark.sparkContext._docloom_paths = [p for p in getattr(spark.sparkContext, "_docloom_paths", ()) if p not in paths]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(key: Column, salt: str = "") -> Column:
    """32 bits of the MD5 of a key written as text, as a long; null counts as the text ``null``.

    Any SQL engine can compute it, and it is the same in every run.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def power_of_two(n: int, per: int, most: int) -> int:
    """The least power of two of at least ``n / per``, between 1 and ``most``."""
    out = 1
    while out < most and out * per < n:
        out *= 2
    return out


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
