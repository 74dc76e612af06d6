"""Behaviour logs: responses to stimuli, joined events, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_responses(stimuli: DataFrame, responses: DataFrame, start: int = 200, stop: int = 1500, last: bool = False) -> DataFrame:
    """Each stimulus with its first (or last) response in [start, stop] ms after it, and the reaction time.

    Both have subject and time_ms, stimuli an event_id.  The window is cut in buckets of its own length, so
    a stimulus meets at most the responses of three buckets of its subject; stimuli without response stay.
    """
    bucket = max(1, stop - start)
    wide = stimuli.select("event_id", "subject", "time_ms").withColumn("bucket", F.explode(F.sequence(F.expr(f"(time_ms + {start}) div {bucket}"), F.expr(f"(time_ms + {stop}) div {bucket}"))))
    own = responses.select("subject", F.col("time_ms").alias("response_ms"), F.col("event_id").alias("response_id")).withColumn("bucket", F.expr(f"response_ms div {bucket}"))
    hits = wide.join(own, ["subject", "bucket"]).where(F.col("response_ms").between(F.col("time_ms") + start, F.col("time_ms") + stop))
    pick = (F.max_by if last else F.min_by)(F.struct("response_ms", "response_id"), F.struct("response_ms", "response_id"))
    best = hits.groupBy("subject", "event_id").agg(pick.alias("r")).select("subject", "event_id", F.col("r.response_ms").alias("response_ms"), F.col("r.response_id").alias("response_id"))
    return stimuli.join(best, ["subject", "event_id"], "left").withColumn("rt_ms", F.col("response_ms") - F.col("time_ms"))


def join_adjacent(events: DataFrame, by: str, order: list[str], event: str = "event") -> DataFrame:
    """Runs of equal events become one: (by, run, event, first, n)."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce((F.col(event) != F.lag(event).over(w)).cast("int"), F.lit(1))
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.first(event).alias("event"), F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("n"))


def duration_to_next(events: DataFrame, by: str, order: list[str], own: str = "duration_ms") -> DataFrame:
    """The time to the subject's next event as ``duration_ms``; the last event keeps its own duration (null if it has none)."""
    w = Window.partitionBy(by).orderBy(*order)
    kept = F.col(own) if own in events.columns else F.lit(None).cast("long")
    return events.withColumn("duration_ms", F.coalesce(F.lead(order[0]).over(w) - F.col(order[0]), kept))
