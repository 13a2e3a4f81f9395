"""Feature store, precomputed features and lookup snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.urls import LEXICAL, FeatureSet, staged, url_features
from urlrisk.operators.dedupe import keep_first
from urlrisk.operators.skew import ROWS_PER_TASK, hot_keys, lookup_join, snapshot_join
from urlrisk.schema import FEATURES, PRECOMPUTED_FEATURES


def without_precomputed(urls: DataFrame, precomputed: DataFrame) -> DataFrame:
    """URLs whose features have to be extracted."""
    return urls.join(precomputed.select("url"), "url", "left_anti")


def precomputed_in(precomputed: DataFrame, urls: DataFrame) -> DataFrame:
    """Precomputed rows whose URL the data set holds."""
    return precomputed.join(urls.select("url"), "url", "left_semi")


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    wide, parts = staged(df, url)
    return wide.select(*df.columns, parts.host.alias("host"))


def dns_table(dns: DataFrame) -> DataFrame:
    """One row per host: it resolves if any of its rows says so, so a lookup never multiplies URLs."""
    return dns.groupBy("host").agg(F.max(F.col("resolved").cast("int")).alias("dns_record"))


def with_domain_age(
    df: DataFrame, registrations: DataFrame, as_of, row_id: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``domain_age_days`` at ``as_of`` from a registration snapshot, else null."""
    first = registrations.groupBy("host").agg(F.min("created").alias("created"))
    joined = snapshot_join(with_host(df), first, "host", row_id, rows_per_task)
    return joined.withColumn("domain_age_days", F.datediff(F.lit(as_of).cast("date"), "created")).drop(
        "created"
    )


def extract(
    urls: DataFrame, dns: DataFrame, row_id: Sequence[str],
    features: FeatureSet = LEXICAL, rows_per_task: int = ROWS_PER_TASK, unique_hosts: bool = False,
) -> DataFrame:
    """All features of every URL plus ``status``; failed rows keep null features.

    ``dns_record`` comes from a host snapshot; unknown and empty hosts get 0. With
    ``unique_hosts`` the snapshot is what :func:`dns_table` returned. The URLs may
    be a stream.
    """
    rows = url_features(urls, features=features, keep_host=True)
    hosts = with_host(urls).select("host")
    joined = snapshot_join(rows, dns if unique_hosts else dns_table(dns), "host", row_id, rows_per_task, hosts).drop("host")
    resolved = F.when(F.col("status") == "ok", F.coalesce("dns_record", F.lit(0)))
    return joined.withColumn("dns_record", resolved)


def failed(extracted: DataFrame) -> DataFrame:
    return extracted.filter("status = 'failed'")


def cache_lookup(
    requests: DataFrame, store: DataFrame, dns: DataFrame, row_id: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Features of every request row, stored ones first, the rest extracted.

    ``hit`` tells which. Stored values win. The lexical features of a miss come
    from the same projection, so one join serves hits and misses. Hot URLs are
    counted on the requests, so that pass does not repeat the host join.
    """
    stored = store.select(
        "url",
        F.lit(True).alias("_hit"),
        *[F.col(name).alias(f"_{name}") for name in FEATURES],
    )
    joined = lookup_join(
        extract(requests, dns, row_id, rows_per_task=rows_per_task),
        stored, "url", row_id, hot=hot_keys(requests, "url", rows_per_task),
    )
    hit = F.col("_hit").isNotNull()
    merged = [F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in FEATURES]
    return joined.select(*requests.columns, hit.alias("hit"), *merged, "status")


def common_urls(left: DataFrame, right: DataFrame) -> DataFrame:
    """URLs in both tables; each side is made distinct before it is shuffled to the join."""
    return left.select("url").distinct().join(right.select("url").distinct(), "url", "left_semi")


def latest(store: DataFrame) -> DataFrame:
    """The newest row of each URL in the append-only feature store."""
    return keep_first(store, "url", [F.desc("version")])


def store_hits(requests: DataFrame, store: DataFrame, rows_per_task: int = ROWS_PER_TASK, row_id: Sequence[str] = ("line",)) -> DataFrame:
    """``(url, hit)`` per request, without any features: what a report of hits needs."""
    known = store.select("url", F.lit(True).alias("_hit")).distinct()
    joined = lookup_join(requests, known, "url", row_id, "left", rows_per_task)
    return joined.select("url", F.col("_hit").isNotNull().alias("hit"))


def hit_ratio(looked_up: DataFrame) -> DataFrame:
    """One row: requests, hits and their share (null for no requests)."""
    return looked_up.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if("hit").alias("n_hits"),
    ).withColumn("hit_ratio", F.try_divide(F.col("n_hits").cast("double"), F.col("n_requests")))


def feature_table(
    urls: DataFrame, precomputed: DataFrame | None, dns: DataFrame, row_id: Sequence[str] = ("url",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Model inputs of every extractable URL of a de-duplicated table.

    Precomputed values replace the extracted ones they cover; the features they
    lack are extracted like everybody else's, never filled with zeros.
    """
    rows = extract(urls, dns, row_id, rows_per_task=rows_per_task).filter("status = 'ok'").drop("status")
    if precomputed is None:
        return rows
    given = precomputed.select("url", *[F.col(name).alias(f"_{name}") for name in PRECOMPUTED_FEATURES])
    joined = rows.join(given, "url", "left")
    for name in PRECOMPUTED_FEATURES:
        joined = joined.withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
    return joined


def features_union(extracted: DataFrame, precomputed: DataFrame) -> DataFrame:
    """Stack extracted and precomputed rows; absent features count as 0."""
    stacked = extracted.unionByName(precomputed, allowMissingColumns=True)
    return stacked.select("url", *[F.coalesce(name, F.lit(0)).alias(name) for name in FEATURES])


def training_set(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """Features with their label, matched by URL (both sides hold unique URLs)."""
    return features.select("url", *FEATURES).join(labelled.select("url", "label"), "url")
