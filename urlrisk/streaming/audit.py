"""Windowed counts; the same code serves batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_audit(requests: DataFrame, window: str, limit: int, client: str = "user_id") -> DataFrame:
    """Requests per client and window, with a flag for the ones above ``limit``."""
    return (
        requests.groupBy(F.window("ts", window).alias("_window"), client)
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .select(
            F.col("_window.start").alias("window_start"),
            client,
            "n_requests",
            (F.col("n_requests") > limit).alias("over_limit"),
        )
    )


def predictions_hourly(log: DataFrame) -> DataFrame:
    """Logged predictions per hour and result."""
    return (
        log.groupBy(F.window("ts", "1 hour").alias("_window"), "result")
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .select(F.col("_window.start").alias("window_start"), "result", "n_predictions")
    )


def with_event_time(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A stream ready for the windows above: event time and how late a row may be."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
