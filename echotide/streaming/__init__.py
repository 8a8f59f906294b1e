"""Live curves with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotide.functions import first_order


def live_curve(points: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts", key: str = "scan_id", value: str = "value") -> DataFrame:
    """Mean, count and largest value per key and time window of a stream; rows later than `late` are dropped."""
    timed = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = timed.groupBy(window.alias("w"), key).agg(F.avg(value).alias("value"), F.count("*").alias("n"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "value", "n", "high")


def live_sessions(points: DataFrame, gap: str = "1 hour", late: str = "1 hour", time: str = "ts", key: str = "scan_id", value: str = "value") -> DataFrame:
    """As live_curve, over sessions that end with a gap."""
    timed = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "value", "n")


def live_first_order(points: DataFrame, length: str = "1 day", late: str = "1 hour", time: str = "ts", key: str = "scan_id", value: str = "value") -> DataFrame:
    """Moments of each window: the first-order statistics that need no sorting."""
    timed = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    named = first_order(F.col(value))
    kept = {k: named[k] for k in ("Mean", "Std", "Max", "Min", "Variance", "Skewness", "Kurtosis", "Range", "Energy")}
    return timed.groupBy(F.window(time, length).alias("w"), key).agg(*(c.alias(n) for n, c in kept.items()))
