"""Windows over events, in batch and as a stream; a micro-batch uses the same exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n_events): counts per window and type."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), "event_type", "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n_events): runs of a user's events closer than the gap."""
    held = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return held.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def stream_windows(events: DataFrame, checkpoint: str, name: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Start a stream of closed windows into a memory table; events later than the watermark are dropped.

    Times without a zone are read in the session's.
    """
    rows = tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
    return rows.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
