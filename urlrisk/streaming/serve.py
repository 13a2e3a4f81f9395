"""Streaming jobs: score incoming requests, fold found links into a table."""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from urlrisk.functions.urls import strip
from urlrisk.operators.dedupe import new_rows
from urlrisk.operators.lookups import dns_table, extract
from urlrisk.operators.metrics import answer_columns
from urlrisk.plans.forest import Forest
from urlrisk.plans.model import apply_model
from urlrisk.plans.scoring import prediction_log
from urlrisk.schema import CACHE_TTL_SECONDS, REQUESTS
from urlrisk.session import materialize
from urlrisk.sources.readers import explode_requests
from urlrisk.sources.sinks import append_segment, read_table
from urlrisk.streaming import reports
from urlrisk.streaming.fresh import flag_fresh

# Input of one micro-batch, where the caller names no number of files.
BYTES_PER_TRIGGER = 256 << 20


def read_requests(
    spark: SparkSession, path: str, files_per_trigger: int | None = None,
    bytes_per_trigger: int = BYTES_PER_TRIGGER, bodies: bool = False,
) -> DataFrame:
    """Request files as a stream; a micro-batch reads so many files, or else so many bytes.

    With ``bodies`` the files hold a JSON ``body`` in place of ``url``, and each
    URL it asks for is a request of its own, numbered by ``position``.
    """
    schema = T.StructType([*REQUESTS.fields[:-1], T.StructField("body", T.StringType())]) if bodies else REQUESTS
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    rows = reader.parquet(path)
    return explode_requests(rows) if bodies else rows


def writer_of(batch: DataFrame, checkpoint: str) -> str:
    """Name of the running stream: its id, which lives as long as its checkpoint."""
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return (query_id or hashlib.sha256(checkpoint.encode()).hexdigest()).replace("-", "")[:32]


def stream_score(
    requests: DataFrame,
    model: PipelineModel | Forest,
    dns: DataFrame,
    answers: str,
    log: str,
    checkpoint: str,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    trigger: dict | None = None,
    counts: str | None = None,
) -> StreamingQuery:
    """Answer every request, however late; log only the fresh ones.

    With ``counts`` each micro-batch adds to the running reports there.

    Features, snapshot join and model are projections of the stream, made once for
    each URL of a pack (:mod:`urlrisk.streaming.fresh`). A repeated request gets the
    answer that the state of its URL holds, also after a restart with another model
    or snapshot. Each micro-batch writes its own segment of both tables, so a
    repeated micro-batch replaces its first attempt.
    """
    trimmed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "url", F.coalesce(strip("url"), F.lit(""))
    )
    # One row per host, written once: every micro-batch joins the same snapshot.
    hosts = materialize(dns_table(dns), "hosts")

    def scored(urls: DataFrame) -> DataFrame:
        return apply_model(model, extract(urls, hosts, ["url"], unique_hosts=True))

    flagged = flag_fresh(trimmed, ttl_seconds, answer=("prediction", "confidence"), scored=scored)
    answered = flagged.select(
        *trimmed.columns, "fresh", *answer_columns(), F.col("confidence").alias("probability")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, writer_of(batch, checkpoint)
        path = append_segment(batch, answers, batch_id, writer)
        written = spark.read.parquet(path)
        append_segment(prediction_log(written.filter("fresh")), log, batch_id, writer)
        if counts:
            reports.add(reports.of_answers(written), counts, batch_id, writer)

    return (
        answered.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_merge(
    found: DataFrame, table: str, checkpoint: str, order: tuple[str, ...] = ("link_ord",)
) -> StreamingQuery:
    """Fold a stream of ``(url, label, order...)`` rows into a labelled table.

    Only new URLs are written, as one segment per micro-batch, named after this
    stream so that batch merges and other streams keep theirs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        segment, writer = batch_id + 1, writer_of(batch, checkpoint)
        existing = read_table(batch.sparkSession, table, below_segment=segment, writer=writer)
        first = batch.limit(0).select("url", "label") if existing is None else existing
        added = new_rows(first, batch, order).select("url", "label")
        append_segment(added, table, segment, writer)

    return (
        found.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
