"""Request streams: time to live, rate audit, logs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.catalogue.fixtures import oracle, view
from urlrisk.catalogue.registry import query
from urlrisk.functions.labels import result_name
from urlrisk.operators import metrics, ttl
from urlrisk.operators.skew import hot_keys, lookup_join
from urlrisk.schema import REQUESTS, REQUESTS_PER_SECOND
from urlrisk.session import materialize, new_path
from urlrisk.sources import sinks
from urlrisk.streaming import audit, serve
from urlrisk.streaming.fresh import flag_fresh

FRESH = {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS k FROM requests",
    "walk": """SELECT *, ts AS anchor, true AS fresh FROM ranked WHERE k = 1 UNION ALL
      SELECT r.*, CASE WHEN r.ts >= w.anchor + INTERVAL 1 HOUR THEN r.ts ELSE w.anchor END,
        r.ts >= w.anchor + INTERVAL 1 HOUR
      FROM walk w JOIN ranked r ON r.url = w.url AND r.k = w.k + 1""",
}


@query(oracle("requests", "SELECT event_id, user_id, ts, url FROM walk WHERE fresh", FRESH, recursive=True))
def ttl_first_seen(spark, sf_dir):
    return ttl.first_seen(view(spark, sf_dir, "requests"))


# Requests in one file of a stream's source; a micro-batch reads whole files.
FILE_ROWS = 1_000_000


def add_files(requests: DataFrame, path: str, n: int, least: int) -> None:
    """Add ``n`` requests to a stream's source as ``least`` files or more, which the stream reads in order of time."""
    spark, before = requests.sparkSession, set(_files(requests.sparkSession, path))
    parts = max(least, -(-n // FILE_ROWS))
    requests.repartitionByRange(parts, "ts", "event_id").write.mode("append").parquet(path)
    # A stream takes files by their time of modification, and tasks end in any order.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, now = folder.getFileSystem(spark._jsc.hadoopConfiguration()), int(time.time() * 1000)
    for k, name in enumerate(sorted(set(_files(spark, path)) - before)):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), now + k, -1)


def _files(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    return [name for name in names if name.startswith("part-")]


def request_files(spark, sf_dir) -> str:
    """The request table as files in order of time, what a stream reads."""
    source = new_path(spark, "requests")
    requests = view(spark, sf_dir, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    requests = materialize(requests.select(*REQUESTS.names), "request-table")
    add_files(requests, source, requests.count(), 4)
    return source


@query(oracle("requests", "SELECT event_id, url, fresh FROM walk", FRESH, recursive=True))
def stream_fresh(spark, sf_dir):
    """The flags a stream gives to the whole request table."""
    out = new_path(spark, "flags")
    flagged = flag_fresh(serve.read_requests(spark, request_files(spark, sf_dir)))
    writer = flagged.select("event_id", "url", "fresh").writeStream.format("parquet")
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(
        f"{out}/rows"
    ).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _audit_sql(unit: str, limit: int) -> str:
    return oracle(
        "requests",
        f"""SELECT date_trunc('{unit}', ts) AS window_start, user_id, count(*) AS n_requests,
          count(*) > {limit} AS over_limit FROM requests GROUP BY 1, 2""",
    )


@query(_audit_sql("second", REQUESTS_PER_SECOND))
def rate_audit_sec(spark, sf_dir):
    return audit.rate_audit(view(spark, sf_dir, "requests"), "1 second", REQUESTS_PER_SECOND)


# A client that repeats some requests at once, up to twelve times, exceeds what the service allows in a second.
_RETRIES = 13


@query(
    oracle(
        "requests",
        f"""SELECT date_trunc('second', ts) AS window_start, user_id, count(*) AS n_requests,
          count(*) > {REQUESTS_PER_SECOND} AS over_limit
        FROM (SELECT *, unnest(range(event_id % {_RETRIES} + 1)) FROM requests) r GROUP BY 1, 2""",
    )
)
def rate_audit_retries(spark, sf_dir):
    requests = view(spark, sf_dir, "requests")
    tried = requests.withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("event_id") % _RETRIES).cast("int"))))
    return audit.rate_audit(tried, "1 second", REQUESTS_PER_SECOND)


# The service allows REQUESTS_PER_MINUTE; one a minute is what some clients of these tables exceed.
_AUDITED_PER_MINUTE = 1


@query(_audit_sql("minute", _AUDITED_PER_MINUTE))
def rate_audit_min(spark, sf_dir):
    return audit.rate_audit(view(spark, sf_dir, "requests"), "1 minute", _AUDITED_PER_MINUTE)


_LOG = {
    **FRESH,
    "log": """SELECT ts, url, CASE WHEN prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS result,
      confidence FROM walk JOIN raw_scores USING (url) WHERE fresh AND prediction IS NOT NULL""",
}


@query(oracle("requests raw_scores", "SELECT * FROM log", _LOG, recursive=True))
def prediction_log(spark, sf_dir):
    """What the service logs: fresh requests with a score, in full precision."""
    requests = view(spark, sf_dir, "requests")
    scored = lookup_join(
        ttl.first_seen(requests), view(spark, sf_dir, "raw_scores"), "url", ["event_id"],
        hot=hot_keys(requests, "url"),
    )
    return scored.filter("prediction IS NOT NULL").select(
        "ts", "url", result_name("prediction").alias("result"), "confidence"
    )


@query(
    oracle(
        "requests raw_scores",
        "SELECT date_trunc('hour', ts) AS window_start, result, count(*) AS n_predictions FROM log GROUP BY 1, 2",
        _LOG,
        recursive=True,
    )
)
def predictions_hourly(spark, sf_dir):
    return audit.predictions_hourly(prediction_log(spark, sf_dir))


_SCORED = "SELECT url, CASE WHEN prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS result"


@query(
    oracle(
        "raw_scores",
        f"""{_SCORED}, round(confidence * 100, 2) AS confidence,
          CASE WHEN prediction = 1 THEN 'phishing' ELSE 'legitimate' END AS prediction
        FROM raw_scores WHERE prediction IS NOT NULL""",
    )
)
def decode_scores(spark, sf_dir):
    return metrics.decode_scores(view(spark, sf_dir, "raw_scores").filter("prediction IS NOT NULL"))


@query(
    oracle(
        "raw_scores",
        f"""{_SCORED}, round(confidence * 100, 2) AS confidence, CAST(NULL AS VARCHAR) AS error
          FROM raw_scores WHERE prediction IS NOT NULL
        UNION ALL SELECT url, 'Error', 0, 'Unable to verify this URL'
          FROM raw_scores WHERE prediction IS NULL""",
    )
)
def score_errors(spark, sf_dir):
    return metrics.score_errors(view(spark, sf_dir, "raw_scores"))


@query(
    oracle(
        "requests raw_scores",
        """SELECT url || ' - ' || CASE WHEN prediction = 1 THEN 'phishing' ELSE 'legitimate' END
          || ' - ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS value
        FROM requests JOIN raw_scores USING (url) WHERE prediction IS NOT NULL""",
    )
)
def result_lines(spark, sf_dir):
    scored = lookup_join(
        view(spark, sf_dir, "requests"), view(spark, sf_dir, "raw_scores"), "url", ["event_id"], "inner"
    )
    named = scored.filter("prediction IS NOT NULL").withColumn(
        "prediction", F.lower(result_name("prediction"))
    )
    return sinks.result_lines(named)


@query(
    oracle(
        "eval_pairs",
        """SELECT count(*) AS n, tp, fp, fn, CAST(sum(CAST(label = prediction AS INT)) AS DOUBLE) / count(*)
          AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall
        FROM eval_pairs, confusion GROUP BY tp, fp, fn""",
        {
            "confusion": """SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM eval_pairs"""
        },
    )
)
def eval_metrics(spark, sf_dir):
    return metrics.eval_metrics(view(spark, sf_dir, "eval_pairs"))
