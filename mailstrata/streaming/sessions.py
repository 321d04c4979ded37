"""Sessionization of an unbounded stream; the batch operator is what it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, key: str, at: str, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after `idle` without an event: key, first_at, last_at, n.

    State is one row for each open session; the watermark closes a session `late` after its last event and drops what comes
    later than that. Works on streams (append mode) and on tables.
    """
    s = events.withWatermark(at, late) if events.isStreaming else events
    out = s.groupBy(key, F.session_window(at, idle).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "first_at", "last_at", "n")
