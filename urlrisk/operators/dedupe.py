"""Order-dependent choices on unordered rows: keep-first, duplicates, merge.

Every choice is made by an explicit order, and every ``row_number() = 1`` is
cut to one row per key inside each map task before the shuffle (Spark's window
group limit), so a URL with a third of all rows arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.operators.skew import ROWS_PER_TASK, lookup_join

ROW_ORDER = ("src_priority", "row_ord")


def keep_first(
    df: DataFrame, key: str | Sequence[str] = "url", order: Sequence = ROW_ORDER
) -> DataFrame:
    """One row per key: the first in ``order``."""
    ranked = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def first_per_domain(links: DataFrame, order: Sequence[str] = ("seed_ord", "link")) -> DataFrame:
    """The first link of each authority, in seed order."""
    return keep_first(links, "netloc", order)


def later_copies(df: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """All rows that keep-first drops.

    Found by an anti join on the row position, which is unique, instead of a
    window over the copies of a URL: no task ever holds all copies of one.
    """
    winners = keep_first(df, order=order).select(*order)
    return df.join(winners, list(order), "left_anti").select(*df.columns)


def duplicate_members(
    df: DataFrame, order: Sequence[str] = ROW_ORDER, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every row of every URL that occurs more than once.

    The copies are counted map-side first; the rows of a hot URL are then spread
    over several tasks of the semi join.
    """
    repeated = df.groupBy("url").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("url")
    return lookup_join(df, repeated, "url", order, "left_semi", rows_per_task).select(*df.columns)


def label_conflicts(df: DataFrame) -> DataFrame:
    """URLs that occur with both labels."""
    return (
        df.groupBy("url")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("label").alias("_low"),
            F.max("label").alias("_high"),
        )
        .filter(F.col("_low") < F.col("_high"))
        .select("url", "copies")
    )


def new_rows(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose URL the existing table lacks; the first copy of each."""
    return keep_first(incoming, order=order).join(existing.select("url"), "url", "left_anti")


def merge_new(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Existing rows plus the new ones; an existing row always wins."""
    columns = ["url", "label"]
    return existing.select(*columns).unionByName(new_rows(existing, incoming, order).select(*columns))


def merge_report(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: table size before and after, and the rows a merge adds."""
    marked = existing.select(F.lit(False).alias("new")).unionByName(
        new_rows(existing, incoming, order).select(F.lit(True).alias("new"))
    )
    return marked.agg(
        F.count_if(~F.col("new")).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if("new").alias("rows_new"),
    )


def size_report(existing: DataFrame, added: DataFrame) -> DataFrame:
    """The same row where the rows to add are known already: nothing is joined."""
    before = existing.agg(F.count(F.lit(1)).alias("rows_before"))
    new = added.agg(F.count(F.lit(1)).alias("rows_new")).first()[0]
    return before.select("rows_before", (F.col("rows_before") + new).alias("rows_after"), F.lit(new).alias("rows_new"))


def upsert(store: DataFrame, changes: DataFrame, key: str = "url", version: str = "version") -> DataFrame:
    """Latest row per key over an append-only store and its changes."""
    return keep_first(store.unionByName(changes), key, [F.desc(version)])
