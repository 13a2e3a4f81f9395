"""The source files of streams, and answers of a stream whose model was replaced."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_packs import made, streamed
from tests.test_ttl import START, TTL, brute
from urlrisk.catalogue import model_queries, request_queries
from urlrisk.schema import REQUESTS
from urlrisk.streaming import fresh


def test_files_are_read_in_order_of_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(request_queries, "FILE_ROWS", 100)
    events, source = made(), str(tmp_path / "in")
    middle = START + timedelta(seconds=20_000)
    for part in ([e for e in events if e[2] < middle], [e for e in events if e[2] >= middle]):
        request_queries.add_files(spark.createDataFrame(part, REQUESTS).repartition(3), source, len(part), 2)
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).agg(F.min("ts"), F.max("ts"), F.count("*")).first() for f in files]
    assert len(files) >= 15 and all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))
    assert max(span[2] for span in spans) < 300
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 4).parquet(source)
    rows = streamed(spark, tmp_path, fresh.flag_fresh(stream, TTL))
    assert len(rows) == len(events) and {r.event_id for r in rows if r.fresh} == brute(events)


def test_answers_of_a_stream_need_no_order_of_all_requests_of_a_url(spark, monkeypatch):
    def at(hours):
        return datetime(2024, 1, 1) + timedelta(hours=hours)

    rows = [(1, at(0), "u", True), (2, at(1), "u", False), (3, at(5), "u", False), (4, at(6), "u", True), (5, at(7), "u", False),
            (6, None, "u", False), (7, at(6), None, False), (8, at(5), "v", True), (9, at(1), "w", True)]
    served = spark.createDataFrame(rows, "event_id long, ts timestamp, url string, fresh boolean").selectExpr(
        "*", "'x' AS result", "0e0 AS confidence", "'' AS error", "0e0 AS probability"
    )
    half = int((at(5) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    monkeypatch.setattr(model_queries, "_in_halves", lambda *_: (served, half))
    answers = model_queries.stream_answers(spark, "")
    assert "Window" not in answers._jdf.queryExecution().optimizedPlan().toString()
    got = {r.event_id: r.first_model for r in answers.collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: None, 7: None, 8: False, 9: True}
