"""Evaluation and score presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.labels import percent, result_name


def eval_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of class 1; undefined ones are 0."""
    label, prediction = F.col("label"), F.col("prediction")
    counted = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((label == 1) & (prediction == 1)).alias("tp"),
        F.count_if((label == 0) & (prediction == 1)).alias("fp"),
        F.count_if((label == 1) & (prediction == 0)).alias("fn"),
        F.count_if(label == prediction).alias("_correct"),
    )
    return counted.select(
        "n",
        "tp",
        "fp",
        "fn",
        _share(F.col("_correct"), F.col("n")).alias("accuracy"),
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


ERROR_TEXT = "Unable to verify this URL"


def decode_scores(scored: DataFrame) -> DataFrame:
    """Result name, percentage and lower-case name for each scored URL."""
    return scored.select(
        "url",
        result_name("prediction").alias("result"),
        percent("confidence").alias("confidence"),
        F.lower(result_name("prediction")).alias("prediction"),
    )


def answer_columns() -> list[Column]:
    """``result, confidence, error`` of a scored row; an error where it has no score."""
    ok = F.col("prediction").isNotNull()
    return [
        F.when(ok, result_name("prediction")).otherwise("Error").alias("result"),
        F.when(ok, percent("confidence")).otherwise(0.0).alias("confidence"),
        F.when(~ok, ERROR_TEXT).alias("error"),
    ]


def score_errors(scored: DataFrame) -> DataFrame:
    """One row shape for both outcomes; a failed URL never stops its batch."""
    return scored.select("url", *answer_columns())
