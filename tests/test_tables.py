"""De-duplication, sampling, audit: brute force, any partitioning, hot keys."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import dedupe, normalize, quality, sample
from urlrisk.plans import prepare

SCHEMA = "source STRING, src_priority INT, row_ord BIGINT, url STRING, label INT"


@pytest.fixture(scope="module")
def rows():
    """3,000 rows; one URL holds a third of them."""
    rng = random.Random(3)
    made = []
    for i in range(3000):
        url = "https://hot.com" if rng.random() < 0.34 else f"https://u{rng.randrange(900)}.com"
        priority = rng.choice([1, 2, 3])
        made.append((("structured", "flat", "ranked")[priority - 1], priority, i, url, rng.randrange(2)))
    return made


def layouts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [df.coalesce(1), df.repartition(16), df.orderBy(F.desc("row_ord"))]


def first_rows(rows):
    best = {}
    for row in rows:
        if row[3] not in best or row[1:3] < best[row[3]][1:3]:
            best[row[3]] = row
    return best


def test_keep_first(spark, rows):
    want = set(first_rows(rows).values())
    for df in layouts(spark, rows):
        assert {tuple(r) for r in dedupe.keep_first(df).collect()} == want


def test_keep_first_limits_each_task_before_the_shuffle(spark, rows):
    plan = dedupe.keep_first(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_later_copies_and_members(spark, rows):
    winners = set(first_rows(rows).values())
    copies = Counter(r[3] for r in rows)
    for df in layouts(spark, rows):
        assert {tuple(r) for r in dedupe.later_copies(df).collect()} == set(rows) - winners
        for rows_per_task in (10, 10**6):
            members = [tuple(r) for r in dedupe.duplicate_members(df, rows_per_task=rows_per_task).collect()]
            assert sorted(members) == sorted(r for r in rows if copies[r[3]] > 1)


def test_label_conflicts(spark, rows):
    labels = defaultdict(set)
    for row in rows:
        labels[row[3]].add(row[4])
    got = dedupe.label_conflicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.url for r in got} == {u for u, seen in labels.items() if len(seen) == 2}


def test_merge_keeps_existing_rows(spark):
    existing = spark.createDataFrame([("a", 0), ("b", 1)], "url STRING, label INT")
    found = spark.createDataFrame([("b", 0, 1), ("c", 1, 3), ("c", 0, 2), ("d", 1, 4)], "url STRING, label INT, n INT")
    merged = dedupe.merge_new(existing, found, ("n",)).collect()
    assert {tuple(r) for r in merged} == {("a", 0), ("b", 1), ("c", 0), ("d", 1)}
    report = dedupe.merge_report(existing, found, ("n",)).first()
    assert tuple(report) == (2, 4, 2)


def test_upsert_takes_the_latest(spark):
    store = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "url STRING, x INT, version INT")
    new = spark.createDataFrame([("b", 2, 2), ("c", 2, 2), ("b", 3, 3)], "url STRING, x INT, version INT")
    assert {tuple(r) for r in dedupe.upsert(store, new).collect()} == {("a", 1, 1), ("b", 3, 3), ("c", 2, 2)}


def brute_sample(pairs, cap):
    classes = defaultdict(list)
    for url, label in pairs:
        classes[label].append((hashlib.md5(f"42|{url}".encode()).hexdigest(), url))
    target = min(len(classes[0]), len(classes[1]), cap)
    return {(url, label) for label in (0, 1) for _, url in sorted(classes[label])[:target]}


@pytest.mark.parametrize("cap", [0, 1, 7, 300, 18_000])
def test_balanced_sample(spark, cap):
    pairs = [(f"https://s{i}.com", int(i % 5 == 0)) for i in range(4000)]
    df = spark.createDataFrame(pairs, "url STRING, label INT")
    want = brute_sample(pairs, cap)
    for part in (df.coalesce(1), df.repartition(16)):
        got = [tuple(r) for r in sample.balanced_sample(part, cap).collect()]
        assert len(got) == len(want) and set(got) == want


def test_sample_of_a_missing_class_is_empty(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "url STRING, label INT")
    assert sample.balanced_sample(df).count() == 0
    assert tuple(sample.class_balance(df).first()) == (2, 0, 0)


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(20_000).select(F.concat(F.lit("https://"), "id").alias("url"))
    train, test = sample.train_test_split(df)
    assert train.count() + test.count() == 20_000
    assert train.intersect(test).count() == 0
    assert 0.78 < train.count() / 20_000 < 0.82


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1)], "url STRING, label INT")
    got = {r.label: r.weight for r in sample.class_weights(df).collect()}
    assert got == {0: 4 / 6, 1: 2.0}
    assert sample.with_class_weight(df).count() == 4


def make_sources(spark):
    structured = spark.createDataFrame(
        [
            (1, "http", "a.com", "x", "yes"), (2, None, "b.com", None, "no"), (3, "http", None, "p", "no"),
            (4, "http", "c.com", "", "maybe"), (5, "ftp", "d.com", "", "no"), (6, None, None, None, "no"),
        ],
        "row_ord BIGINT, protocol STRING, domain_name STRING, address STRING, is_phished STRING",
    )
    flat = spark.createDataFrame(
        [
            (1, "http://a.com/x", "good"), (2, "e.com", "Bad"), (3, "e.com", "0"), (4, "f.com", "GOOD"),
            (5, None, "1"), (6, "'g.com", "1"), (7, "h.com", "1.0"),
        ],
        "row_ord BIGINT, URL STRING, LABEL STRING",
    )
    ranked = spark.createDataFrame(
        [(1, "e.com"), (2, " i.com "), (3, " "), (4, None), (5, "123")], "row_ord BIGINT, domain STRING"
    )
    return prepare.Sources(structured, flat, ranked)


def test_prepare_end_to_end(spark):
    audited = make_sources(spark).audited()
    kept = {(r.url, r.label, r.source) for r in prepare.clean_urls(audited).collect()}
    assert kept == {
        ("http://a.com/x", 1, "structured"), ("http://b.com/", 0, "structured"),
        ("https://e.com", 1, "flat"), ("https://h.com", 1, "flat"), ("https://i.com", 0, "ranked"),
    }
    dropped = {(r.source, r.row_ord): r.reason for r in quality.rejects(audited).collect()}
    assert dropped == {
        ("structured", 3): "bad_host", ("structured", 4): "bad_label", ("structured", 5): "bad_scheme",
        ("structured", 6): "null_url", ("flat", 1): "duplicate", ("flat", 3): "duplicate",
        ("flat", 4): "bad_label", ("flat", 5): "null_url", ("flat", 6): "bad_host",
        ("ranked", 1): "duplicate", ("ranked", 3): "null_url", ("ranked", 4): "null_url",
        ("ranked", 5): "numeric_host",
    }
    report = {(r.source, r.reason): r.n_dropped for r in quality.drop_report(audited).collect()}
    assert report[(None, None)] == 13 and report[("flat", "duplicate")] == 2 and report[("ranked", None)] == 4
    sampled = prepare.prepare(make_sources(spark))
    assert sorted(r.label for r in sampled.collect()) == [0, 0, 1, 1]


def test_numeric_label_column(spark):
    df = spark.createDataFrame([(1, "a.com", 1), (2, "b.com", 0), (3, "c.com", 2)], "row_ord INT, URL STRING, LABEL INT")
    assert [r.label for r in normalize.normalize_flat(df).orderBy("row_ord").collect()] == [1, 0, None]


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "a.com")], "row_ord INT, site STRING")
    with pytest.raises(ValueError, match="LABEL"):
        normalize.normalize_flat(df)
    assert normalize.normalize_ranked(df).first().url == "https://a.com"
    with pytest.raises(ValueError):
        normalize.rename_precomputed(df)


def test_precomputed_renames(spark):
    names = "url STRING, long_url STRING, `having_@_symbol` STRING, prefix_suffix_seperation STRING, sub_domains STRING"
    df = spark.createDataFrame([("a", "54", "0", "1", "1.0"), ("b", "5", None, "1", "1")], names)
    assert [tuple(r) for r in normalize.rename_precomputed(df).collect()] == [("a", 54, 0, 1, 1)]
