"""Batch inputs: delimited files, lines, request bodies, tables."""

from __future__ import annotations

import logging
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk.functions.labels import missing_to_null
from urlrisk.functions.urls import strip

logger = logging.getLogger(__name__)


def read_csv(
    spark: SparkSession, path: str, header: bool = True, quoted_newlines: bool | None = None
) -> DataFrame:
    """A CSV table as text columns plus ``row_ord``, its position in the input.

    Missing-value spellings become null. A record may hold line breaks inside
    quotes only if some line of its file has an odd number of quotes; one parallel
    pass over the lines finds these files. They are read whole, each by one task,
    all other files in splits. Pass ``quoted_newlines`` to skip that pass and read
    all files the same way.
    """
    if quoted_newlines is not None:
        return _csv(spark, [path], header, quoted_newlines)
    whole = _files_with_open_quotes(spark, path)
    if not whole:
        return _csv(spark, [path], header, False)
    split = [file for file in map(_plain, spark.read.text(path).inputFiles()) if file not in whole]
    rows = _csv(spark, sorted(whole), header, True)
    return rows.unionByName(_csv(spark, split, header, False)) if split else rows


def _csv(spark: SparkSession, paths: list[str], header: bool, quoted_newlines: bool) -> DataFrame:
    table = (
        spark.read.option("header", header)
        .option("escape", '"')
        .option("multiLine", quoted_newlines)
        .csv(paths)
    )
    return table.select(
        *[missing_to_null(f"`{name}`").alias(name) for name in table.columns],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("row_ord"),
    )


def _plain(uri: str) -> str:
    """A file as a reader takes it; local files are spelled with one or three slashes."""
    return re.sub("^file:/+", "file:///", unquote(uri))


def _files_with_open_quotes(spark: SparkSession, path: str) -> set[str]:
    """Files in which some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return {_plain(row["file"]) for row in lines.filter(quotes % 2 == 1).select("file").distinct().collect()}


def read_required(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV table that must exist; raises the reader's error otherwise."""
    return read_csv(spark, path, **options)


def read_optional(
    spark: SparkSession, path: str | None, schema: T.StructType, any_columns: bool = False, **options
) -> DataFrame:
    """A CSV table, or an empty one of ``schema`` with a warning if it is absent.

    Unless ``any_columns``, a table that lacks a column of ``schema`` is left out
    the same way.
    """
    if path:
        try:
            table = read_csv(spark, path, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            logger.warning("%s not found", path)
        else:
            missing = [name for name in schema.names if name not in table.columns]
            if any_columns or not missing:
                return table
            logger.error("expected columns %s in %s; found %s", schema.names, path, table.columns)
    return spark.createDataFrame([], schema)


ROW_ORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)


def text_schema(*names: str) -> T.StructType:
    """Schema of an absent source: text columns and the row position."""
    fields = [T.StructField(name, T.StringType()) for name in names]
    return T.StructType([*fields, T.StructField("row_ord", ROW_ORD)])


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, stripped, without blank lines."""
    return url_lines(spark.read.text(path))


def url_lines(lines: DataFrame) -> DataFrame:
    return lines.select(strip("value").alias("url")).filter("url <> ''")


REQUEST_BODY = "url STRING, urls ARRAY<STRING>"


def explode_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per URL asked for: the ``urls`` list, else the single ``url``.

    A body with neither keeps one row with a null URL, which scores as an error.
    """
    parsed = requests.withColumn("_body", F.from_json(body, REQUEST_BODY))
    urls = F.coalesce("_body.urls", F.array("_body.url"), F.array(F.lit(None).cast("string")))
    return (
        parsed.select("*", F.posexplode_outer(urls).alias("position", "_url"))
        .withColumn("url", strip("_url"))
        .drop("_body", "_url", body)
    )
