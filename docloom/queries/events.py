"""Queries of windowed events: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.queries.base import Family, table
from docloom.streaming import ingest

FAMILY = Family()


@FAMILY.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Events by hour and type."""
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@FAMILY.add(
    """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_sessions(spark, sf_dir):
    """Sessions of users."""
    return ingest.sessions(table(spark, sf_dir, "events"))


@FAMILY.add("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def event_latest(spark, sf_dir):
    """The newest event of each user."""
    return ingest.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "ts")
