"""Running reports equal the batch queries, after late data, repeated batches and merged segments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import lookups, quality
from urlrisk.plans import forest, jobs, prepare, scoring
from urlrisk.schema import REQUESTS
from urlrisk.sources import readers, sinks
from urlrisk.streaming import audit, reports, serve

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    pick = random.Random(6)
    urls = ["http://hot.com/", "http://a.com/x", "http://[bad", "http://b.com"]
    rows = [
        (i, i % 3, START + timedelta(seconds=pick.choice([pick.randrange(20_000), 5])), pick.choice(urls[: 1 + i % 4])) for i in range(900)
    ]
    return rows + [(1000, 1, None, "http://a.com/x")]


def same(one, other):
    return sorted(map(str, (tuple(r) for r in one.collect()))) == sorted(map(str, (tuple(r) for r in other.select(*one.columns).collect())))


def test_streamed_reports_equal_batch_queries(spark, tmp_path, monkeypatch, events):
    monkeypatch.setattr(sinks, "FAN", 3)
    model = forest.Forest((forest.Node(0, 1, None, None, None, None, 0.75),))
    dns = spark.createDataFrame([("a.com", 1)], "host string, resolved int")
    paths = [str(tmp_path / name) for name in ("answers", "log", "checkpoint")]
    counts = str(tmp_path / "reports")
    for k in range(7):  # no order of time between the batches: all data may be late
        spark.createDataFrame(events[k::7], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = serve.read_requests(spark, str(tmp_path / "in"), files_per_trigger=1)
    serve.stream_score(stream, model, dns, *paths, counts=counts).awaitTermination()
    answers = sinks.read_table(spark, paths[0])
    assert answers.count() == len(events)
    timed = answers.filter("ts IS NOT NULL")
    assert same(audit.rate_audit(timed, "1 second", 2), reports.rates(spark, counts, reports.RATE_SECOND, 2))
    assert same(audit.rate_audit(timed, "1 minute", 3), reports.rates(spark, counts, reports.RATE_MINUTE, 3))
    hourly = audit.predictions_hourly(scoring.prediction_log(timed.filter("fresh")))
    got = reports.read(spark, counts, reports.PREDICTIONS).select("window_start", F.col("key").alias("result"), F.col("n").alias("n_predictions"))
    assert same(hourly, got) and got.count() > 1
    total = reports.ratio(spark, counts, reports.REQUESTS).first()
    assert total.n_requests == len(events) and total.n_hits == answers.filter("NOT fresh").count()
    # A batch that is repeated, be it merged already or not, changes nothing.
    state = sinks.manifest.load(spark, counts)[1]
    assert len(state["segments"]) < 7
    before = reports.read(spark, counts).collect()
    writer = next(iter(state["absorbed"]))
    reports.add(reports.of_answers(answers), counts, 0, writer)
    last = next(x for x in state["segments"] if not x["level"])
    again = spark.read.parquet(f"{counts}/{last['path']}").drop("_segment", "_writer")
    reports.add(spark.createDataFrame(again.collect(), again.schema), counts, last["number"], writer)
    assert sorted(map(str, before)) == sorted(map(str, reports.read(spark, counts).collect()))


def test_reports_of_nothing(spark, tmp_path):
    assert reports.read(spark, str(tmp_path / "none")).count() == 0
    assert tuple(reports.ratio(spark, str(tmp_path / "none")).first()) == (0, 0, None)


def test_jobs_add_to_reports(spark, tmp_path, capsys):
    def run(*argv):
        args = jobs.parser().parse_args([str(a) for a in argv])
        args.run(spark, args)

    (tmp_path / "flat.csv").write_text("URL,LABEL\na.com,good\na.com,bad\n'q.com,1\nb.com,maybe\nc.com,1\n")
    for _ in range(2):
        run("prepare", "--flat", tmp_path / "flat.csv", "--out", tmp_path / "table", "--reports", tmp_path / "reports")
    absent = readers.text_schema("protocol", "domain_name", "address", "is_phished"), readers.text_schema("domain")
    structured, ranked = (readers.read_optional(spark, None, names) for names in absent)
    sources = prepare.Sources(structured, readers.read_csv(spark, str(tmp_path / "flat.csv")), ranked)
    audited = prepare.audited_table(sources)
    want = {(r.source, r.reason): r.n_dropped for r in quality.drop_report(audited).collect() if r.source and r.reason}
    got = {(r.source, r.key): r.n for r in reports.read(spark, str(tmp_path / "reports"), reports.DROPS).collect()}
    assert got == want and sum(got.values()) == 3
    stages = {r.key: r.n for r in reports.read(spark, str(tmp_path / "reports"), reports.STAGES).collect()}
    assert stages == {"rows_read": 5, "rows_valid_url": 4, "rows_accepted": 3}

    dns = spark.createDataFrame([("a.com", 1)], "host string, resolved int")
    dns.write.parquet(str(tmp_path / "dns"))
    forest.Forest((forest.Node(0, 1, None, None, None, None, 0.75),)).save(spark, str(tmp_path / "model"))
    stored = lookups.extract(spark.createDataFrame([("http://a.com",)], "url string"), dns, ["url"]).drop("status")
    sinks.append_segment(stored.withColumn("version", F.lit(1).cast("long")), str(tmp_path / "store"))
    (tmp_path / "urls.txt").write_text("http://a.com\nhttp://b.com\nhttp://a.com\n")
    run("score", "--input", tmp_path / "urls.txt", "--store", tmp_path / "store", "--dns", tmp_path / "dns",
        "--model", tmp_path / "model", "--out", tmp_path / "scores", "--reports", tmp_path / "reports")
    assert tuple(reports.ratio(spark, str(tmp_path / "reports")).first()) == (3, 2, 2 / 3)
    capsys.readouterr()
    run("reports", "--reports", tmp_path / "reports")
    assert "store_hits" in capsys.readouterr().out
    run("reports", "--reports", tmp_path / "reports", "--report", "drop_report", "--out", tmp_path / "out")
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
