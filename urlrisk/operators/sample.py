"""Class balancing, train/test split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.schema import CLASS_CAP, SEED
from urlrisk.session import materialize

# Hash prefixes grow by four hex digits: at most 65,536 counts each time.
_PREFIX, _HASH_DIGITS = 4, 32
# Rows of one prefix that are put in order.
RANKED_ROWS = 100_000
# First two hex digits below cd: 205 of 256 hash buckets, 80.1 %.
_TRAIN_BELOW = "cd"


def sample_key(seed: int = SEED) -> Column:
    """Pseudo-random but fixed order of the URLs, equal on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("url")))


def class_balance(df: DataFrame, cap: int = CLASS_CAP) -> DataFrame:
    """One row: rows per class and the common sample size."""
    return df.agg(
        F.count_if(F.col("label") == 0).alias("n_legitimate"),
        F.count_if(F.col("label") == 1).alias("n_phishing"),
    ).withColumn(
        "target", F.least("n_legitimate", "n_phishing", F.lit(cap)).cast("bigint")
    )


def balanced_sample(df: DataFrame, cap: int = CLASS_CAP, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n0, n1, cap)`` rows of each class, without replacement.

    ``df`` holds unique URLs. The sample of a class is what comes first by hash, so
    it is a filter up to its last row. That row is found by counting: the rows per
    hash prefix tell in which prefix the sample ends, the rows of that prefix are
    counted by a longer one, until few enough are left to be ordered. Classes are
    never ranked, no row of the sample is shuffled for it, and a table of counts
    has at most 65,536 rows per class whatever the size of the data. The rows are
    written once, as they are read for each count.
    """
    rows = df.filter(F.col("label").isin(0, 1))
    keyed = materialize(rows.withColumn("_hash", sample_key(seed)), "sample-rows")
    totals = {row["label"]: row["n"] for row in keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = min(totals.get(0, 0), totals.get(1, 0), cap)
    if not target:
        return df.limit(0)
    keep = F.lit(False)
    for label in (0, 1):
        last_hash, last_url = _last_taken(keyed.filter(F.col("label") == label), target)
        before = (F.col("_hash") < last_hash) | ((F.col("_hash") == last_hash) & (F.col("url") <= last_url))
        keep = keep | ((F.col("label") == label) & before)
    return keyed.filter(keep).select(*df.columns)


def _last_taken(rows: DataFrame, left: int) -> tuple[str, str]:
    """Hash and URL of the row at place ``left`` in the order of the hashes."""
    size = _PREFIX
    while True:
        counts = materialize(
            rows.groupBy(F.substring("_hash", 1, size).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")), "prefix-counts"
        )
        upto = F.sum("_n").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0))
        end = counts.withColumn("_upto", upto).filter(F.col("_upto") >= left).orderBy("_prefix").first()
        rows = rows.filter(F.substring("_hash", 1, size) == end["_prefix"])
        left -= end["_upto"] - end["_n"]
        if end["_n"] <= RANKED_ROWS or size >= _HASH_DIGITS:
            break
        size += _PREFIX
    first = rows.select("_hash", "url").orderBy("_hash", "url").limit(left)
    last = first.agg(F.max(F.struct("_hash", "url")).alias("_last")).first()["_last"]
    return last["_hash"], last["url"]


def is_train(seed: int = SEED) -> Column:
    """True for about 80 % of the URLs; depends on the URL alone, so no sort."""
    digest = F.md5(F.concat(F.lit(f"split|{seed}|"), F.col("url")))
    return F.substring(digest, 1, 2) < _TRAIN_BELOW


def train_test_split(df: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    return df.filter(is_train(seed)), df.filter(~is_train(seed))


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class; at most two rows."""
    n0, n1 = F.col("_n0"), F.col("_n1")
    counted = train.agg(
        F.count_if(F.col("label") == 0).alias("_n0"), F.count_if(F.col("label") == 1).alias("_n1")
    )
    classes = F.when(n0 > 0, 1).otherwise(0) + F.when(n1 > 0, 1).otherwise(0)
    rows = F.array(
        F.struct(F.lit(0).alias("label"), n0.alias("n")), F.struct(F.lit(1).alias("label"), n1.alias("n"))
    )
    return (
        counted.select(F.inline(rows), (n0 + n1).cast("double").alias("_all"), classes.alias("_classes"))
        .filter("n > 0")
        .select("label", "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("weight"))
    )


def with_class_weight(train: DataFrame) -> DataFrame:
    return train.join(F.broadcast(class_weights(train).select("label", "weight")), "label")
