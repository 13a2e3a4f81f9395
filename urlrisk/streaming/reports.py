"""Running reports: counts that streams and jobs add to and that equal the batch queries at any time.

A report is a table of partial counts per key. Each micro-batch or run adds its
own as one segment, so a repeated one replaces itself; counts of a key are summed
when they are read and when segments are merged. Rows may come late in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.sources import sinks

KEYS = ("report", "window_start", "source", "key")
SCHEMA = "report string, window_start timestamp, source string, key string, n long, hits long"

RATE_SECOND, RATE_MINUTE, PREDICTIONS, REQUESTS = "rate_second", "rate_minute", "predictions_hourly", "requests_hourly"
STAGES, DROPS, STORE = "stage_counts", "drop_report", "store_hits"


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _entry(report: str, key: Column, window: Column | None = None, hit: Column | None = None, source: Column | None = None) -> Column:
    return F.struct(
        F.lit(report).alias("report"),
        (F.lit(None).cast("timestamp") if window is None else window).alias("window_start"),
        (F.lit(None).cast("string") if source is None else source).alias("source"),
        key.cast("string").alias("key"),
        (F.lit(False) if hit is None else hit).alias("hit"),
    )


def of_answers(answered: DataFrame, client: str = "user_id") -> DataFrame:
    """Counts of answered requests: per client and second, client and minute, result and hour, hits per hour.

    One pass and one shuffle of counts for all of them. A request without a time
    counts in none but the requests, whose hour is then null.
    """
    timed = F.col("ts").isNotNull()
    logged = timed & F.col("fresh") & (F.col("result") != "Error")
    entries = F.array(
        F.when(timed, _entry(RATE_SECOND, F.col(client), F.date_trunc("second", "ts"))),
        F.when(timed, _entry(RATE_MINUTE, F.col(client), F.date_trunc("minute", "ts"))),
        F.when(logged, _entry(PREDICTIONS, F.col("result"), F.date_trunc("hour", "ts"))),
        _entry(REQUESTS, F.lit("answers"), F.date_trunc("hour", "ts"), ~F.col("fresh")),
    )
    return _counted(answered.select(F.explode(entries).alias("e")).filter("e IS NOT NULL").select("e.*"))


def of_lookups(looked_up: DataFrame) -> DataFrame:
    """Requests and hits of a feature store, over rows with ``hit``."""
    return _counted(looked_up.select(_entry(STORE, F.lit("features"), hit=F.col("hit")).alias("e")).select("e.*"))


def _counted(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


def of_prepare(stage_counts: DataFrame, drops: DataFrame) -> DataFrame:
    """The stage counts and drop counts of one prepared set of sources, without the subtotals."""
    none = F.lit(None).cast("timestamp")
    stages = F.explode(
        F.array(*(F.struct(F.lit(name).alias("key"), F.col(name).alias("n")) for name in ("rows_read", "rows_valid_url", "rows_accepted")))
    )
    counted = stage_counts.select("source", stages.alias("s")).select(
        F.lit(STAGES).alias("report"), none.alias("window_start"), "source", "s.key", "s.n", F.lit(0).cast("long").alias("hits")
    )
    dropped = drops.filter("source IS NOT NULL AND reason IS NOT NULL").select(
        F.lit(DROPS).alias("report"), none.alias("window_start"), "source", F.col("reason").alias("key"),
        F.col("n_dropped").alias("n"), F.lit(0).cast("long").alias("hits"),
    )
    return counted.unionByName(dropped)


def add(counts: DataFrame, path: str, number: int, writer: str) -> None:
    """Add the counts of batch or run ``number`` of ``writer``; once, however often it is repeated."""
    sinks.append_segment(counts, path, number, writer, combine=summed)


def read(spark: SparkSession, path: str, report: str | None = None) -> DataFrame:
    """``(report, window_start, source, key, n, hits)``: everything that was added, one row per key."""
    counts = sinks.read_table(spark, path)
    counts = spark.createDataFrame([], SCHEMA) if counts is None else counts
    return summed(counts if report is None else counts.filter(F.col("report") == report))


def rates(spark: SparkSession, path: str, report: str, limit: int) -> DataFrame:
    """A rate report as the audit gives it: requests per window and client, flagged above ``limit``."""
    return read(spark, path, report).select(
        "window_start", F.col("key").cast("long").alias("user_id"), F.col("n").alias("n_requests"), (F.col("n") > limit).alias("over_limit")
    )


def ratio(spark: SparkSession, path: str, report: str = STORE) -> DataFrame:
    """One row: requests, hits and their share (null for no requests) over all windows."""
    total = read(spark, path, report).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_requests"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_hits")
    )
    return total.withColumn("hit_ratio", F.try_divide(F.col("n_hits").cast("double"), F.col("n_requests")))
