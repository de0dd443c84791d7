"""Tool calls as sessions, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A session ends after so long without a call; calls that come later than this behind the newest are too late for a stream.
GAP, LATE = "2 hours", "1 day"


def session_numbers(calls: DataFrame) -> DataFrame:
    """``calls`` with ``session``, counted from 1 for each user: a call belongs to the one before if it comes within the gap."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(w) >= F.col("ts") - F.expr(f"INTERVAL {GAP}"), 0).otherwise(1)
    return calls.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def session_windows(calls: DataFrame, late: str = LATE) -> DataFrame:
    """``user_id, first, last, calls`` per session; the same for batches and streams.

    On a stream a session comes out once the newest call is ``late`` after its end; calls later than that are dropped, which
    is this library's own policy.
    """
    w = calls.withWatermark("ts", late) if calls.isStreaming else calls
    got = w.groupBy("user_id", F.session_window("ts", f"{GAP}").alias("_w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("calls"))
    return got.select("user_id", "first", "last", "calls")


def hourly(calls: DataFrame, late: str = LATE) -> DataFrame:
    """Calls per hour and tool."""
    w = calls.withWatermark("ts", late) if calls.isStreaming else calls
    return w.groupBy(F.window("ts", "1 hour").alias("_w"), "event_type").agg(F.count("*").alias("calls")).select(F.col("_w.start").alias("hour"), "event_type", "calls")


def follow(stream: DataFrame, to: str, checkpoint: str, available_now: bool = True):
    """Writes a stream of sessions to Parquet, each once."""
    out = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
