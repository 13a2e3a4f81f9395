"""Streams pack the requests of a URL before the shuffle."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_ttl import START, TTL, brute
from urlrisk.operators.ttl import fresh_positions
from urlrisk.schema import REQUESTS
from urlrisk.streaming import fresh


def made(n=1500, urls=40):
    rng = random.Random(5)
    return [
        (i, i % 7, START + timedelta(seconds=rng.choice([rng.randrange(40_000), rng.randrange(0, 40_000, TTL)])),
         "hot" if i % 3 == 0 else f"u{rng.randrange(urls)}")
        for i in range(n)
    ]


def streamed(spark, path, flagged):
    flagged.writeStream.format("parquet").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start(
        f"{path}/out"
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def test_positions_over_packs_equal_those_of_one_list():
    rng = random.Random(8)
    for _ in range(300):
        rows = sorted((rng.randrange(60), rng.random() < 0.1, k) for k in range(rng.randrange(1, 40)))
        packs = [[] for _ in range(rng.randrange(1, 6))]
        for row in rows:
            rng.choice(packs).append(row)
        times, no_ids, ids = ([np.array([row[k] for row in pack], np.int64) for pack in packs] for k in range(3))
        ttl, anchor = rng.choice([0, 1, 7, 30]), rng.choice([None, -20, 5])
        want, _ = fresh_positions([row[0] for row in rows], ttl, anchor)
        got = fresh.fresh_in_packs(times, ids, no_ids, ttl, anchor)
        assert [packs[pack][at] for pack, at in got] == [rows[at] for at in want]


@pytest.mark.parametrize("size", [1, 64, 1 << 17])
def test_any_size_of_packs(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(fresh, "PACK_ROWS", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        events = made()
        spark.createDataFrame(events, REQUESTS).repartition(3).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        rows = streamed(spark, tmp_path, fresh.flag_fresh(stream, TTL))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.event_id, r.user_id, r.ts, r.url) for r in rows) == events
    assert {r.event_id for r in rows if r.fresh} == brute(events)


def test_a_url_reaches_the_state_once_per_pack(spark):
    df = spark.createDataFrame(made(), REQUESTS).repartition(2)
    packed, lists = fresh._pack(df, ())
    rows = packed.collect()
    assert len(rows) <= 2 * df.select("url").distinct().count() and sum(len(r.event_id) for r in rows) == 1500
    assert all(len(r[name]) == len(r.event_id) for r in rows for name in lists)
    assert all(list(r._micros) == sorted(r._micros) for r in rows)


def test_nulls_and_large_numbers_pass_unchanged(spark, tmp_path):
    large = (1 << 60) + 1
    events = [(large, None, START, "u"), (None, large, START, "u"), (None, None, None, "u"), (7, large, START, None), (8, None, START, "")]
    spark.createDataFrame(events, REQUESTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = streamed(spark, tmp_path, fresh.flag_fresh(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), TTL))
    got = {tuple(r) for r in rows}
    assert got == {(*event, event[0] == large) for event in events}


def test_what_depends_on_the_url_is_asked_once_per_pack(spark, tmp_path):
    events = made()
    spark.createDataFrame(events, REQUESTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))

    def scored(urls):
        return urls.withColumn("mark", F.when(F.col("url") != "u1", F.expr("uuid()"))).withColumn("size", F.when(F.col("url") != "u2", F.length("url")))

    rows = streamed(spark, tmp_path, fresh.flag_fresh(stream, TTL, answer=("mark", "size"), scored=scored))
    assert len(rows) == len(events) and {r.event_id for r in rows if r.fresh} == brute(events)
    marks = {}
    for r in rows:
        marks.setdefault(r.url, set()).add(r.mark)
        assert r.size == (None if r.url == "u2" else len(r.url))
    assert all(len(found) == 1 for found in marks.values()) and marks["u1"] == {None}
