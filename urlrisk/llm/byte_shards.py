"""Contiguous shards of nearly equal bytes from a global prefix sum of sizes.

Rows are put in id order by range partitions. One total per partition is summed
up over the partitions, which are few, and a running sum inside each partition
gives every row its place among all bytes; equal targets cut that line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.session import materialize

# Bytes that every row takes besides its text.
ROW_BYTES = 16


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def balanced_shards(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``: one row per row of ``docs``.

    Rows are ordered by id (nulls first), then by checksum and size of the text;
    rows equal in all of these are told apart by where they were read. A row
    belongs to the shard in which the middle of its bytes falls, so shards are
    contiguous in that order and differ by less than one row from equal bytes.
    ``slot`` counts from 0 inside a shard. A null text has no bytes and no
    checksum of its own: it counts as empty. Other columns are not looked at.
    An empty table gives an empty result.

    Sizes are written once to the shared folder, without texts; each of the
    three later steps reads that table, so a lost executor changes nothing.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.col(id_col).alias("_id"), text_size(F.col(text_col)).alias("_size"), F.crc32(text).alias("_crc")
    )
    # The row number is fixed by the file it is written to; ranges are then cut on
    # written values, so that one id with very many rows is split as well.
    sizes = materialize(sizes.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    order = ["_id", "_crc", "_size", "_row"]
    ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        sizes.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "size-ranges"
    )
    totals = placed.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # One row per range: this window is over partitions, never over rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rank"),
    )
    total = totals.agg(F.sum("_bytes").alias("_total"))
    offsets = starts.join(F.broadcast(total))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.col("_upto") - F.col("_size") / 2
    cut = F.floor(middle * F.lit(n_shards) / F.col("_total")).cast("int")
    lined = (
        placed.withColumn("_upto", F.sum("_size").over(within))
        .withColumn("_nth", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_range")
        .withColumn("_shard", F.least(cut, F.lit(n_shards - 1)))
        .withColumn("_place", F.col("_rank") + F.col("_nth"))
    )
    lined = materialize(lined.select("_id", "_size", "_crc", "_shard", "_place"), "lined")
    # At most n_shards rows.
    first = lined.groupBy("_shard").agg(F.min("_place").alias("_first"))
    return lined.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - F.col("_first")).alias("slot"),
    )
