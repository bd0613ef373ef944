"""Event-time roll-ups on a stream: tumbling windows and sessions under a watermark.

A row counts as late when its time is before the watermark: the latest event time of the batches before it,
less ``lateness``. Late rows whose window is closed are dropped, and the query's progress counts them
(`dropped_rows`); rows that come within ``lateness`` are counted as if they had come in order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "2 hours"


def user_windows(events: DataFrame, length: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """(hour, event_type, user_id, n, total): a state row per user, so that distinct users are counted by summing
    rows and no set grows inside one."""
    timed = events.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type", "user_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "user_id", "n", "total")


def write_windows(events: DataFrame, folder: str, checkpoint: str, length: str = "1 hour", lateness: str = LATENESS) -> StreamingQuery:
    """Every batch writes the window rows it changed; `read_windows` takes the latest of each."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return user_windows(events, length, lateness).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(rows: DataFrame) -> DataFrame:
    """(hour, event_type, n_events, n_users, total) from the batches written so far."""
    last = rows.groupBy("hour", "event_type", "user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.groupBy("hour", "event_type").agg(F.sum("v.n").alias("n_events"), F.count("*").alias("n_users"), F.sum("v.total").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """(user_id, started, last_event, n_events) of every session, once the watermark has passed its end."""
    timed = events.withWatermark("ts", lateness)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n_events")).select("user_id", "started", "last_event", "n_events")


def write_sessions(events: DataFrame, folder: str, checkpoint: str, gap: str = "6 hours", lateness: str = LATENESS) -> StreamingQuery:
    """Closed sessions, each written once. The last ones stay in the state until later events close them. A
    batch's watermark takes effect in the next one, so two batches with a row far ahead close all; rows without
    a user make no session of their own."""
    # the second condition, never true, keeps the filter above the watermark, which such a row must reach
    named = F.col("user_id").isNotNull() | (F.col("n_events") < 0)
    return sessions(events, gap, lateness).where(named).writeStream.outputMode("append").format("parquet").option(
        "path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Late rows that the query has dropped."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
