"""Streaming queries; each gives what the batch query over the same files gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from archloom.streaming.incremental import tick

from .kit import query, table


def _events(spark, sf_dir, transform, mode="append"):
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as a stream over one file needs
    return tick(spark, path, table(spark, sf_dir, "events").schema, transform, mode)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The seen-set as stream state."""
    return _events(spark, sf_dir, lambda s: s.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("stream_counters", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def stream_counters(spark, sf_dir):
    """Counters as running aggregates; distinct users are counted from the deduplicated state."""
    per_user = _events(spark, sf_dir, lambda s: s.groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "complete")
    return per_user.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))


@query("stream_tick", "SELECT event_id, user_id FROM events WHERE value > 90")
def stream_tick(spark, sf_dir):
    return _events(spark, sf_dir, lambda s: s.where("value > 90").select("event_id", "user_id"))
