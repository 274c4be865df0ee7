"""First-seen findings of a stream, and counts of events by time.

The windowed counts on events are an extension; the tracker is the streaming
form of `relational.ingest`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import fingerprint


def first_seen(findings: DataFrame, at: str = "seen_at", late: str = "1 day") -> DataFrame:
    """Each fingerprint once, in state open. State older than the watermark is dropped, so it does not grow for ever."""
    keyed = findings.withColumn("fingerprint", fingerprint()).withWatermark(at, late)
    return keyed.dropDuplicatesWithinWatermark(["fingerprint"]).withColumn("state", F.lit("open"))


def counts_by_window(events: DataFrame, at: str, by: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Rows of each kind in tumbling windows; batch or stream."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), by, "n")
