"""Event-time streams: quality windows, responses to stimuli, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_windows(events: DataFrame, length: str = "1 hour", slide: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and moments of overlapping windows, by event; late rows are dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def responses(stimuli: DataFrame, answers: DataFrame, start_ms: int = 200, stop_ms: int = 1500, late: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join; the window bounds what either side keeps in state."""
    s = stimuli.select("event_id", F.col("user_id").alias("s_user"), F.col("ts").alias("s_ts")).withWatermark("s_ts", late)
    r = answers.select(F.col("event_id").alias("r_id"), F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts")).withWatermark("r_ts", late)
    inside = f"s_user = r_user AND r_ts >= s_ts + INTERVAL {start_ms} MILLISECONDS AND r_ts <= s_ts + INTERVAL {stop_ms} MILLISECONDS"
    return s.join(r, F.expr(inside))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Bursts of a user's events without a pause longer than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
