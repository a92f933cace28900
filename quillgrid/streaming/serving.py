"""Session-aware request streams with Structured Streaming.

Each function takes a frame with (session, ts, key, kind, epoch) and works alike
on a batch and on a stream; state is bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(requests: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions end after ``gap`` without a request."""
    df = requests.withWatermark("ts", late) if late else requests
    w = F.session_window("ts", gap)
    return df.groupBy("session", w).agg(F.count("*").alias("requests")).select(
        "session", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "requests"
    )


def first_by_key(requests: DataFrame, late: str | None = None) -> DataFrame:
    """One row for each (session, key): on a stream the first to arrive within the watermark."""
    if late:
        return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "key"])
    return requests.groupBy("session", "key").agg(F.min(F.struct("ts", "kind")).alias("f")).select("session", "key", "f.ts", "f.kind")


def stage_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "kind", "n")


def latest_epoch(requests: DataFrame) -> DataFrame:
    """Of each session the request with the greatest (epoch, ts): later epochs win, stale ones drop."""
    return requests.groupBy("session").agg(F.max(F.struct("epoch", "ts", "key")).alias("m")).select("session", "m.epoch", "m.ts", "m.key")
