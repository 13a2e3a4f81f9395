"""Score URL tables and request tables with a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.lookups import cache_lookup, extract, latest
from urlrisk.operators.metrics import answer_columns
from urlrisk.operators.skew import ROWS_PER_TASK, hot_keys, lookup_join
from urlrisk.plans.forest import Forest
from urlrisk.plans.model import apply_model


def score_urls(
    urls: DataFrame, model: PipelineModel | Forest, dns: DataFrame, row_id: Sequence[str] = ("url",),
    store: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``prediction`` and ``confidence`` per row; nulls where features failed.

    With a feature ``store`` its rows are used first and the rest is extracted.
    """
    if store is None:
        rows = extract(urls, dns, row_id, rows_per_task=rows_per_task)
    else:
        rows = cache_lookup(urls, latest(store), dns, row_id, rows_per_task)
    return apply_model(model, rows).select(*urls.columns, "prediction", "confidence", "status")


def score_requests(requests: DataFrame, model: PipelineModel | Forest, dns: DataFrame) -> DataFrame:
    """An answer for every request row.

    Each distinct URL is scored once (the distinct is partly done before the
    shuffle, so repeats cost little) and the answer joined back.
    """
    scores = score_urls(requests.select("url").distinct(), model, dns)
    answered = lookup_join(
        requests, scores.drop("status"), "url", ["event_id"], hot=hot_keys(requests, "url")
    )
    return answered.select(*requests.columns, *answer_columns(), F.col("confidence").alias("probability"))


def prediction_log(answered: DataFrame) -> DataFrame:
    """Log rows of answered requests: time, URL, result, unrounded confidence."""
    return answered.filter("result <> 'Error'").select(
        "ts", "url", "result", F.col("probability").alias("confidence")
    )
