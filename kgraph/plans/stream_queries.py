"""Queries that run streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest as i
from .base import query


def _events(spark, sf_dir):
    e = i.read_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "boundary").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"))


@query(
    "stream_segments",
    "L6 L7 F1",
    """SELECT user_id::VARCHAR AS session_id, event_id AS id, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seq FROM events""",
)
def stream_segments(spark, sf_dir):
    return i.run(i.segment(_events(spark, sf_dir))).drop("batch")


@query("stream_hash_dedup", "L1 L2", "SELECT DISTINCT user_id::VARCHAR AS project, event_type AS file FROM events")
def stream_hash_dedup(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("session_id").alias("project"), "kind", "at").withColumn("file", F.when(F.col("kind") == "boundary", "signup").otherwise(F.col("kind")))
    return i.run(i.changed_files(rows.select("project", "file", F.sha2("file", 256).alias("hash"), "at"), "3650 days")).select("project", "file")


@query(
    "stream_tumbling_windows",
    "DM3",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE event_type WHEN 'signup' THEN 'boundary' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_tumbling_windows(spark, sf_dir):
    out = i.run(i.windowed_counts(_events(spark, sf_dir), "1 day"), mode="complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")
