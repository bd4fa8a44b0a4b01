"""Structured Streaming forms: the same rules over unbounded events (ts, table, user, rows), with a ten-minute watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalar import mass_severity

WATERMARK = "10 minutes"


def rates(events: DataFrame, key: str, rows: str, width: str = "60 seconds") -> DataFrame:
    """Rows by key and minute; a minute comes out when the watermark has passed it, later rows are dropped as the monitor prunes them."""
    w = F.window("ts", width)
    return events.withWatermark("ts", WATERMARK).groupBy(w, key).agg(F.sum(rows).alias("rows")).select(F.col("window.start").alias("start"), key, "rows")


def hotspots(times: DataFrame, key: str, gap_s: int = 60, least: int = 5) -> DataFrame:
    """Clusters of a key's times whose gaps are gap_s at most; streaming sessions need a key."""
    s = times.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", f"{gap_s} seconds").alias("s"), key).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.filter(F.col("n") >= least).select(key, "n", "first", "last")


def mass_operations(events: DataFrame, rows: str) -> DataFrame:
    """Stateless: events that touch 50 rows or more."""
    return events.withColumn("severity", mass_severity(F.col(rows))).filter("severity <> 'NONE'")
