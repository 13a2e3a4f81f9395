"""Accept or reject every row with a reason, and count the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.functions.urls import is_valid_url, with_reject_reason
from urlrisk.operators.dedupe import keep_first, later_copies

_REJECT_COLUMNS = ["source", "src_priority", "row_ord", "url", "reason"]
# The rows to keep, over the columns of an audited table.
_GOOD = "valid AND label IS NOT NULL"


def audit(rows: DataFrame) -> DataFrame:
    """Add ``valid``: whether the URL is accepted. Checked once, with one pattern."""
    return rows.withColumn("valid", is_valid_url("url"))


def accepted(audited: DataFrame) -> DataFrame:
    return audited.filter(_GOOD).drop("valid")


def bad_rows(audited: DataFrame) -> DataFrame:
    """Rows without a valid URL or a usable label, with the reason."""
    reasoned = with_reject_reason(audited.filter(f"NOT ({_GOOD})"))
    return reasoned.withColumn("reason", F.coalesce("reason", F.lit("bad_label")))


def rejects(audited: DataFrame) -> DataFrame:
    """Every dropped row with its reason, repeated URLs included."""
    repeated = later_copies(accepted(audited)).withColumn("reason", F.lit("duplicate"))
    return bad_rows(audited).select(*_REJECT_COLUMNS).unionByName(repeated.select(*_REJECT_COLUMNS))


def stage_counts(audited: DataFrame) -> DataFrame:
    """Rows per source: read, with a valid URL, and with a usable label too."""
    return audited.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if("valid").alias("rows_valid_url"),
        F.count_if(F.expr(_GOOD)).alias("rows_accepted"),
    )


def drop_report(audited: DataFrame) -> DataFrame:
    """Dropped rows by source and reason, with subtotals (null means all).

    Repeated URLs are counted as accepted minus surviving rows per source, so
    no row-level join is needed for the report.
    """
    bad = bad_rows(audited).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    good = accepted(audited)
    survivors = keep_first(good).groupBy("source").agg(F.count(F.lit(1)).alias("_kept"))
    repeated = (
        good.groupBy("source")
        .agg(F.count(F.lit(1)).alias("_good"))
        .join(survivors, "source", "left")
        .select(
            "source",
            F.lit("duplicate").alias("reason"),
            (F.col("_good") - F.coalesce("_kept", F.lit(0))).alias("n"),
        )
        .filter("n > 0")
    )
    return bad.unionByName(repeated).rollup("source", "reason").agg(F.sum("n").alias("n_dropped"))


def reject_preview(dropped: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rejects of each source, as the audit log shows them."""
    order = Window.partitionBy("source").orderBy("row_ord", "reason")
    return (
        dropped.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )
