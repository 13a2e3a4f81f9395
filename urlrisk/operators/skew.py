"""Joins against a keyed table when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task should get at most, on tables up to HOT_SHARE times as large.
ROWS_PER_TASK = 1_000_000
# A key is hot if it holds more than this part of all rows, so fewer than HOT_SHARE keys can be:
# the list of them needs no limit of its own, and a key that is not on it is no larger than a task's share.
HOT_SHARE = 10_000
# Keys that a sketch tracks. It overrates a count by less than 1 / (0.75 * TRACKED) of the rows, under half of a hot key.
TRACKED = 1 << 15
# Sketches of the tasks are merged in so many groups, then the groups.
MERGERS = 64

# A lookup table is broadcast by request only if it was counted to be within both.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 2**20


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(_key, _fan)``: hash of each hot key and into how many parts to split it.

    Found by a frequent-items sketch in one pass: no key is shuffled, each task
    sends one sketch of bounded size. Hot are keys with more than
    ``rows_per_task`` rows and more than 1 / HOT_SHARE of all. A hash collision or
    an overrated count merely splits a key that did not need it.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_part")
    sketches = (
        df.select(part, F.xxhash64(key).alias("_key"))
        .groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.expr(f"approx_top_k_accumulate(_key, {TRACKED})").alias("_sketch"))
    )
    merged = F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch, {TRACKED}), {HOT_SHARE})")
    # Grouped by a constant: an empty partition would have a sketch of no type, which can not be merged.
    found = sketches.groupBy(F.lit("all")).agg(F.sum("_n").alias("_n"), merged.alias("_top"))
    found = found.select("_n", F.inline("_top").alias("_key", "_count"))
    unit = F.greatest(F.lit(rows_per_task), F.ceil(F.col("_n") / HOT_SHARE))
    # Fewer than HOT_SHARE rows: kept here, so that the pass runs once for both sides of a join.
    rows = found.filter(F.col("_count") > unit).select("_key", F.ceil(F.col("_count") / unit).cast("int").alias("_fan")).collect()
    return df.sparkSession.createDataFrame([tuple(row) for row in rows], "_key long, _fan int")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    row_id: Sequence[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows per key to a table with at most one row per key.

    Rows of a hot key are spread over several parts and its table row is copied
    to each part; all other keys go through unchanged. The part of a row is a
    hash of ``row_id``, columns that tell its rows apart, so a re-run task puts
    every row where the first attempt did. When the table is small Spark turns
    the join into a broadcast join by its own size check.

    ``hot`` is the result of :func:`hot_keys` where the caller can find the keys
    on something cheaper than ``facts``, such as the input of an earlier join that
    is part of ``facts``. Without hot keys this is a plain join.
    """
    hot = hot_keys(facts, key, rows_per_task) if hot is None else hot
    if hot.isEmpty():
        return facts.join(table, key, how)
    hot = F.broadcast(hot)
    part = F.when(F.col("_fan").isNotNull(), F.pmod(F.xxhash64(*row_id), F.col("_fan"))).otherwise(0)
    spread = (
        facts.withColumn("_key", F.xxhash64(key))
        .join(hot, "_key", "left")
        .withColumn("_part", part.cast("int"))
        .drop("_key", "_fan")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)
    copied = (
        table.withColumn("_key", F.xxhash64(key))
        .join(hot, "_key", "left")
        .withColumn("_part", F.explode(copies))
        .drop("_key", "_fan")
    )
    return spread.join(copied, [key, "_part"], how).drop("_part")


def snapshot_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    row_id: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Left join to a stored snapshot with one narrow row per key.

    The snapshot is counted first. A small one is broadcast, and the facts are
    neither counted nor shuffled; a larger one goes through :func:`lookup_join`.
    ``keys`` has the key column of ``facts`` from a cheaper plan. Rows of a stream
    are not counted: a trigger bounds what one micro-batch joins.
    """
    if facts.isStreaming and not fits_broadcast(table, key):
        return facts.join(table, key, "left")
    if fits_broadcast(table, key):
        return facts.join(F.broadcast(table), key, "left")
    hot = hot_keys(facts if keys is None else keys, key, rows_per_task)
    return lookup_join(facts, table, key, row_id, hot=hot)


def fits_broadcast(table: DataFrame, key: str) -> bool:
    """Whether the rows of ``table``, all their columns, are few and small enough to be sent to every task."""
    width = F.lit(0)
    for field in table.schema.fields:
        simple = field.dataType.simpleString() in ("int", "bigint", "double", "date", "timestamp", "boolean")
        width = width + (F.lit(8) if simple else F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0)))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
