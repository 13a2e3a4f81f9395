"""Lookup joins under skew, the feature store, metrics."""

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import lookups, metrics, skew
from urlrisk.operators.skew import hot_keys, lookup_join
from urlrisk.schema import FEATURES


@pytest.fixture(scope="module")
def facts(spark):
    """One key with a third of the rows, one null key with a sixth."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
    )
    return spark.range(6000).select("id", key.alias("key"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "key STRING, v INT")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [100, 10**6])
@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_lookup_join_equals_a_plain_join(spark, facts, table, how, rows_per_task, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = lookup_join(facts, table, "key", ["id"], how, rows_per_task)
        want = facts.join(table, "key", how).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_keys_are_split(spark, facts):
    fans = {r._key: r._fan for r in hot_keys(facts, "key", 100).collect()}
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert fans[hot] == 20 and len(fans) == 2
    assert hot_keys(facts, "key").count() == 0


def test_thousands_of_hot_keys_in_one_pass(spark):
    """5,000 keys with ten rows each beside 10,000 rows of their own: all are split, none by a shuffle of keys."""
    n = 5_000
    facts = spark.range(0, 12 * n, 1, 6).select("id", F.when(F.col("id") < 10 * n, F.col("id") % n).otherwise(F.col("id")).alias("key"))
    fans = {r._key: r._fan for r in hot_keys(facts, "key", 3).collect()}
    want = spark.range(n).select(F.xxhash64("id")).collect()
    assert len(fans) >= 0.95 * n and {r[0] for r in want} >= set(fans)
    table = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    got = lookup_join(facts, table, "key", ["id"], "inner", rows_per_task=3)
    assert got.agg(F.count("id"), F.sum("v")).first() == facts.join(table, "key").agg(F.count("id"), F.sum("v")).first()


def test_hot_keys_over_empty_partitions(spark, facts):
    assert hot_keys(facts.limit(0), "key").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        for part in (facts, facts.repartition(40, "key"), facts.filter("id < 3").repartition(30)):
            assert hot_keys(part, "key", 100).count() == (2 if part.count() > 3 else 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_broadcast_is_decided_by_whole_rows(spark, monkeypatch):
    wide = spark.createDataFrame([("k", "x" * 1000)], "key STRING, v STRING")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 500)
    assert not skew.fits_broadcast(wide, "key") and skew.fits_broadcast(wide.select("key"), "key")


def urls(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id INT, url STRING")


@pytest.fixture(scope="module")
def dns(spark):
    return spark.createDataFrame([("a.com", 1), ("b.com", 0), ("a.com:80", 1)], "host STRING, resolved INT")


@pytest.mark.parametrize("rows_per_task", [1, 10**6])
@pytest.mark.parametrize("broadcast_rows", [0, 10])
def test_dns_record(spark, dns, rows_per_task, broadcast_rows, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    df = urls(spark, "http://A.com/x", "http://b.com", "http://c.com", "a.com", "http://[x", None, "http://a.com:80")
    got = lookups.extract(df, dns, ["id"], rows_per_task=rows_per_task).orderBy("id").collect()
    assert [r.dns_record for r in got] == [1, 0, 0, 0, None, None, 1]
    assert [r.status for r in got] == ["ok"] * 4 + ["failed"] * 2 + ["ok"]
    assert lookups.failed(lookups.extract(df, dns, ["id"])).count() == 2


def test_cache_lookup_prefers_stored_values(spark, dns):
    store = lookups.extract(urls(spark, "http://a.com").select("url"), dns, ["url"]).withColumn("url_length", F.lit(7))
    asked = urls(spark, "http://a.com", "http://b.com", "http://a.com")
    got = lookups.cache_lookup(asked, store, dns, ["id"], rows_per_task=1)
    assert [(r.hit, r.url_length) for r in got.orderBy("id").collect()] == [(True, 7), (False, 12), (True, 7)]
    assert lookups.hit_ratio(got).first().hit_ratio == 2 / 3
    assert lookups.hit_ratio(got.limit(0)).first().hit_ratio is None


def test_feature_table_prefers_precomputed_and_fills_the_rest(spark, dns):
    data = urls(spark, "http://a.com/q", "http://b.com", "bad").select("url")
    given = spark.createDataFrame(
        [("http://a.com/q", 99, 1, 1, 1), ("http://zzz.com", 1, 1, 1, 1)],
        "url STRING, url_length INT, has_at INT, has_dash INT, has_subdomain INT",
    )
    got = {r.url: r for r in lookups.feature_table(data, given, dns).collect()}
    assert set(got) == {"http://a.com/q", "http://b.com", "bad"}
    row = got["http://a.com/q"]
    assert (row.url_length, row.has_at, row.num_slashes, row.dns_record) == (99, 1, 3, 1)
    assert lookups.without_precomputed(data, given).count() == 2
    assert [r.url for r in lookups.precomputed_in(given, data).collect()] == ["http://a.com/q"]
    labelled = spark.createDataFrame([("http://b.com", 1)], "url STRING, label INT")
    training = lookups.training_set(lookups.feature_table(data, None, dns), labelled).collect()
    assert [(r.url, r.label) for r in training] == [("http://b.com", 1)]
    assert list(training[0].asDict()) == ["url", *FEATURES, "label"]


def test_domain_age(spark):
    created = spark.createDataFrame([("a.com", "2020-01-01")], "host STRING, created STRING").withColumn(
        "created", F.col("created").cast("date")
    )
    got = lookups.with_domain_age(urls(spark, "http://a.com", "http://b.com"), created, "2020-01-31", ["id"])
    assert [r.domain_age_days for r in got.orderBy("id").collect()] == [30, None]


def test_metrics_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "label INT, prediction INT")
    assert tuple(metrics.eval_metrics(empty).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_score_rows(spark):
    scored = spark.createDataFrame(
        [("a", 1, 0.91237), ("b", 0, 0.5), ("c", None, None)], "url STRING, prediction INT, confidence DOUBLE"
    )
    assert [tuple(r) for r in metrics.score_errors(scored).collect()] == [
        ("a", "Phishing", 91.24, None), ("b", "Legitimate", 50.0, None), ("c", "Error", 0.0, metrics.ERROR_TEXT)
    ]
