"""Anchored time to live: brute force = both batch ways = stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import ttl
from urlrisk.schema import REQUESTS
from urlrisk.streaming import audit
from urlrisk.streaming.fresh import flag_fresh

START = datetime(2024, 1, 1)
TTL = 600


@pytest.fixture(scope="module")
def events():
    """2,400 requests in a day; a third for one URL; equal times, gaps, borders."""
    rng = random.Random(11)
    made = []
    for i in range(2400):
        url = "hot" if i % 3 == 0 else f"u{rng.randrange(60)}"
        second = rng.choice([rng.randrange(86_400), rng.randrange(0, 86_400, TTL), rng.randrange(3_000)])
        made.append((i, i % 7, START + timedelta(seconds=second), url))
    return made


def brute(events):
    anchors, fresh = {}, set()
    for event_id, _, at, url in sorted(events, key=lambda e: (e[2], e[0])):
        if url not in anchors or at >= anchors[url] + timedelta(seconds=TTL):
            anchors[url] = at
            fresh.add(event_id)
    return fresh


@pytest.mark.parametrize(("rows_per_task", "cell_rows"), [(10**6, 10), (100, 10**6), (100, 5), (1, 2)])
@pytest.mark.parametrize("parts", [1, 16])
def test_first_seen(spark, events, rows_per_task, cell_rows, parts, monkeypatch):
    monkeypatch.setattr(ttl, "TOP_CELLS", 4)
    df = spark.createDataFrame(events, REQUESTS).repartition(parts)
    got = [r.event_id for r in ttl.first_seen(df, TTL, rows_per_task, cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(events)


def test_dense_url_is_cut_below_one_time_to_live(spark, monkeypatch):
    """All requests of a URL within two times to live, most of them in one second."""
    rng = random.Random(4)
    micros = [rng.randrange(1_000_000) for _ in range(1500)] + [rng.randrange(2 * TTL * 1_000_000) for _ in range(300)]
    events = [(i, 0, START + timedelta(microseconds=m), "u") for i, m in enumerate(micros)]
    df = spark.createDataFrame(events, REQUESTS)
    at = df.select("url", ttl._micros().alias("_at")).distinct()
    width = ttl.cell_width(at, TTL * 1_000_000, 40)
    assert width < 1_000_000
    largest = at.groupBy("url", F.floor(F.col("_at") / width)).count().agg(F.max("count")).first()[0]
    assert largest <= 40
    monkeypatch.setattr(ttl, "TOP_CELLS", 64)
    assert {r.event_id for r in ttl.first_seen(df, TTL, 1, 40).collect()} == brute(events)


def test_only_chained_requests_reach_python(spark, events):
    df = spark.createDataFrame(events, REQUESTS)
    cut = ttl.runs(df, TTL)
    opens = cut.filter("_opens")
    # What opens a run is fresh for sure, what neither opens one nor is chained is not.
    assert {r.event_id for r in opens.collect()} <= brute(events)
    sparse = df.filter("url <> 'hot'")
    assert ttl.runs(sparse, TTL).filter("_chained").count() < 0.6 * sparse.count()
    spaced = spark.createDataFrame([(i, 0, START + timedelta(seconds=700 * (i // 3)), "u") for i in range(90)], REQUESTS)
    assert ttl.runs(spaced, TTL).filter("_chained").count() == 0 and ttl.first_seen(spaced, TTL).count() == 30


def test_pointers_reach_over_empty_slices(spark):
    seconds = [0, 599, 600, 601, 1199, 1200, 5000, 5001, 5600, 9000]
    events = [(i, 0, START + timedelta(seconds=s), "u") for i, s in enumerate(seconds)]
    df = spark.createDataFrame(events, REQUESTS)
    assert {r.event_id for r in ttl.first_seen(df, TTL, 1).collect()} == brute(events)


def test_small_arrow_batches(spark, events):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(events, REQUESTS)
        assert {r.event_id for r in ttl.first_seen(df, TTL).collect()} == brute(events)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def run_stream(spark, tmp_path, events, files):
    ordered = sorted(events, key=lambda e: (e[2], e[0]))
    size = len(ordered) // files + 1
    for i in range(files):
        part = spark.createDataFrame(ordered[i * size:(i + 1) * size], REQUESTS)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(query_writer, tmp_path):
    query = query_writer.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True
    ).start(str(tmp_path / "out"))
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path, events):
    stream = run_stream(spark, tmp_path, events, 4)
    query = finish(flag_fresh(stream, TTL).writeStream, tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(events)
    assert {r.event_id for r in rows if r.fresh} == brute(events)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4


def test_late_request_neither_counts_nor_moves_the_anchor(spark, tmp_path):
    at = [(0, 1000), (1, 900), (2, 1599), (3, 1600)]
    events = [(i, 0, START + timedelta(seconds=s), "u") for i, s in at]
    for event in events:
        spark.createDataFrame([event], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(flag_fresh(stream, TTL).writeStream, tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id: r.fresh for r in rows} == {0: True, 1: False, 2: False, 3: True}


def test_no_request_is_lost(spark, tmp_path):
    hour = 3600
    times = [5 * hour, None, 5 * hour + 1, 0, 6 * hour, hour]
    urls = ["u", "u", None, "u", "", "v"]
    for i, (at, url) in enumerate(zip(times, urls)):
        ts = None if at is None else START + timedelta(seconds=at)
        spark.createDataFrame([(i, 0, ts, url)], REQUESTS).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(flag_fresh(stream, TTL).writeStream, tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id: r.fresh for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_rows_without_time_are_never_fresh_on_either_way(spark):
    events = [(1, 0, None, "u"), (2, 0, START, "u"), (3, 0, START, None), (4, 0, None, None)]
    df = spark.createDataFrame(events, REQUESTS)
    for rows_per_task in (10**6, 1):
        assert [r.event_id for r in ttl.first_seen(df, TTL, rows_per_task).collect()] == [2]


def test_rate_audit_stream_equals_batch(spark, tmp_path, events):
    batch = audit.rate_audit(spark.createDataFrame(events, REQUESTS), "1 minute", 3)
    assert batch.filter("over_limit <> (n_requests > 3)").count() == 0
    assert batch.agg(F.sum("n_requests")).first()[0] == len(events)
    # A last event closes the windows of all others.
    closing = (9999, 0, START + timedelta(days=2), "u")
    stream = audit.with_event_time(run_stream(spark, tmp_path, [*events, closing], 4))
    finish(audit.rate_audit(stream, "1 minute", 3).writeStream, tmp_path)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in batch.collect()}
