"""Sessions and shared working folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "docloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (``local[...]``, as in tests) and without the setting a temporary folder stands in, one an
    application, which goes when the process ends. A cluster must name its folder.
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
    """A path of the shared folder that nothing has been written to; it stays until the application's folder goes."""
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and written to the shared folder: for what is used more than once and must not differ."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once an application, so that Python workers find it wherever they start."""
    if getattr(spark.sparkContext, "_docloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="docloom-ship-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "docloom.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(folder / "docloom.zip"))
    spark.sparkContext._docloom_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Cut Arrow batches to so many rows where the session has Spark's own number: a worker holds a few batches of whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
