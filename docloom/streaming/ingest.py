"""Documents that keep arriving: incremental views with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__r", r).where("__r = 1").drop("__r")


def maintain_view(stream: DataFrame, view: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, by: str = "doc_id"):
    """Append each batch's view rows under its batch number; a replayed batch overwrites its own folder.

    Readers take the newest batch of a document, so a document that comes again replaces its rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        view(batch).withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_view(spark: SparkSession, path: str, *, by: str = "doc_id") -> DataFrame:
    """The maintained view: rows of each document's newest batch."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(by).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [by, "batch"], "left_semi").drop("batch", "epoch")


def windowed_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Events by time window and key, late ones counted up to the watermark; works on streams and tables."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key: events no further apart than ``gap``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
