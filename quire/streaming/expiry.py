"""Jobs that go when nothing has touched them for a while, as a stream of touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states that end a job.
ENDED = ("done", "error", "canceled")


def expired(touches: DataFrame, ttl: Column, late: str = "0 seconds") -> DataFrame:
    """A streaming frame (id, at, status; null where a touch says nothing of it) to id, status, touched_at of each job whose last touch lies more than ttl (an interval of days and less) before the watermark.

    Touches that lie no further apart than ttl are one session; a later one moves its end, and revives a job that would
    have gone. When the watermark has passed a session's end, a job that is still queued or running stays, one that has
    ended goes and is forgotten; a touch after that makes it new. This hangs on the times of touches alone, in whatever
    batches they come. Touches that come later than late behind the newest are left out where the watermark has passed them.
    """
    ms = touches.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + ttl)).alias("ms")).first().ms
    # to the millisecond, as watermarks are
    rows = touches.select("id", F.timestamp_millis(F.unix_millis("at")).alias("at"), "status").withWatermark("at", late)
    sessions = rows.groupBy("id", F.session_window("at", f"{ms + 1} milliseconds"))
    said = F.max(F.when(F.col("status") != "", F.struct("at", "status")))["status"]
    return sessions.agg(F.max("at").alias("touched_at"), said.alias("status")).filter(F.col("status").isin(*ENDED)).select("id", "status", "touched_at")
