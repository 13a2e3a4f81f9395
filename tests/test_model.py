"""Properties of the fitted model and the scoring jobs."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from urlrisk.catalogue.feature_queries import training_set
from urlrisk.catalogue.fixtures import view
from urlrisk.operators.sample import balanced_sample, train_test_split
from urlrisk.plans import expand, model, scoring
from urlrisk.schema import FEATURES, REQUESTS
from urlrisk.sources import sinks
from urlrisk.streaming import serve


@pytest.fixture(scope="module")
def rows(spark):
    return balanced_sample(training_set(spark, "/root/testdata/sf0.01")).coalesce(1).sortWithinPartitions("url")


@pytest.fixture(scope="module")
def trained(rows):
    return model.train(rows, trees=20)


@pytest.fixture(scope="module")
def dns(spark, sf_dir):
    return view(spark, sf_dir, "dns_snapshot")


def test_metrics_equal_the_library_evaluator(rows, trained):
    got = trained.metrics.first()
    _, test = train_test_split(rows)
    scored = model.apply_model(trained.model, test).select(
        F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")
    )
    evaluator = MulticlassClassificationEvaluator(metricLabel=1.0)
    assert got.n == scored.count()
    for name, metric in (("accuracy", "accuracy"), ("precision", "precisionByLabel"), ("recall", "recallByLabel")):
        assert got[name] == pytest.approx(evaluator.evaluate(scored, {evaluator.metricName: metric}))


def test_importances_cover_the_features(trained):
    got = {r.feature: r.importance for r in trained.importances.collect()}
    assert list(got) == FEATURES and sum(got.values()) == pytest.approx(1)


def test_default_forest(rows):
    train, _ = train_test_split(rows)
    forest = model.fit(train.limit(60)).stages[-1]
    assert forest.getNumTrees == 100 and forest.getOrDefault("maxDepth") == 15 and forest.getOrDefault("seed") == 42


def test_same_seed_and_layout_give_the_same_model(rows, trained, tmp_path):
    train, test = train_test_split(rows)
    one, two = model.fit(train, trees=5), model.fit(train, trees=5)
    trained.model.write().overwrite().save(str(tmp_path / "m"))
    stored = PipelineModel.load(str(tmp_path / "m"))
    for a, b in ((one, two), (trained.model, stored)):
        first, second = (model.apply_model(m, test).select("url", "prediction", "confidence") for m in (a, b))
        assert first.exceptAll(second).count() == 0


def test_scores_of_good_and_bad_urls(spark, trained, dns, sf_dir):
    urls = view(spark, sf_dir, "dirty_urls")
    scored = scoring.score_urls(urls, trained.model, dns, ["page_id"]).collect()
    assert len(scored) == urls.count()
    for row in scored:
        if row.status == "ok":
            assert row.prediction in (0, 1) and 0.5 <= row.confidence <= 1
        else:
            assert row.prediction is None and row.confidence is None
    assert {r.status for r in scored} == {"ok", "failed"}


def test_pseudo_labels(spark, trained, dns):
    frontier = spark.createDataFrame([("http://a.com/x",), ("http://[bad",)], "link STRING")
    got = expand.pseudo_label(frontier, trained.model, dns).collect()
    assert [r.url for r in got] == ["http://a.com/x"] and got[0].label in (0, 1)


def test_request_answers(spark, trained, dns):
    requests = spark.createDataFrame(
        [(1, "http://a.com"), (2, "http://a.com"), (3, None), (4, "http://[x")], "event_id INT, url STRING"
    )
    got = {r.event_id: r for r in scoring.score_requests(requests, trained.model, dns).collect()}
    assert got[1].result == got[2].result in ("Phishing", "Legitimate")
    assert got[1].confidence == round(got[1].probability * 100, 2) and got[1].error is None
    assert got[3].result == got[4].result == "Error" and got[3].error and got[4].confidence == 0


def test_stream_scoring(spark, trained, dns, sf_dir, tmp_path):
    requests = view(spark, sf_dir, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    requests = requests.withColumn("url", F.concat(F.lit(" "), "url")).select(*REQUESTS.names)
    requests.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / name) for name in ("answers", "log", "checkpoint")]

    def run():
        serve.stream_score(serve.read_requests(spark, str(tmp_path / "in")), trained.model, dns, *paths).awaitTermination()

    run()
    answers, log = sinks.read_table(spark, paths[0]), sinks.read_table(spark, paths[1])
    assert answers.count() == requests.count() and answers.filter("url LIKE ' %'").count() == 0
    assert log.count() == answers.filter("fresh").count()
    assert 0 < log.count() < answers.count()
    run()
    assert sinks.read_table(spark, paths[0]).count() == requests.count()


def test_stream_merge(spark, tmp_path):
    root, source = str(tmp_path / "table"), str(tmp_path / "in")
    sinks.write_version(spark.createDataFrame([("a", 0)], "url STRING, label INT"), root)
    schema = "url STRING, label INT, link_ord INT"
    for batch in ([("a", 1, 0), ("b", 1, 1), ("b", 0, 0)], [("b", 1, 0), ("c", 1, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        found = spark.readStream.schema(schema).parquet(source)
        serve.stream_merge(found, root, str(tmp_path / "ck")).awaitTermination()
    rows = sorted(tuple(r) for r in sinks.read_table(spark, root).collect())
    assert rows == [("a", 0), ("b", 0), ("c", 1)]


def test_batch_and_stream_merges_keep_each_others_rows(spark, tmp_path):
    root, source = str(tmp_path / "table"), str(tmp_path / "in")
    table = "url STRING, label INT"
    sinks.write_version(spark.createDataFrame([("base", 0)], table), root)
    sinks.append_segment(spark.createDataFrame([("batch", 1)], table), root)
    schema = "url STRING, label INT, link_ord INT"
    for checkpoint, url in (("one", "streamed"), ("two", "again"), ("two", "more")):
        spark.createDataFrame([(url, 1, 0)], schema).coalesce(1).write.mode("append").parquet(source)
        found = spark.readStream.schema(schema).parquet(source)
        serve.stream_merge(found, root, str(tmp_path / checkpoint)).awaitTermination()
    sinks.append_segment(spark.createDataFrame([("later", 1)], table), root)
    rows = sorted(r.url for r in sinks.read_table(spark, root).collect())
    assert rows == ["again", "base", "batch", "later", "more", "streamed"]
