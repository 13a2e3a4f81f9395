"""Node tables against the library's own scores and against plain trees; answers kept by a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from urlrisk.catalogue.feature_queries import training_set
from urlrisk.catalogue.fixtures import view
from urlrisk.operators.sample import train_test_split
from urlrisk.plans import forest, jobs, model
from urlrisk.schema import FEATURES, REQUESTS
from urlrisk.sources import sinks
from urlrisk.streaming import serve

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return training_set(spark, SF).coalesce(2).cache()


def test_flattened_forest_scores_like_the_library(spark, rows):
    train, test = train_test_split(rows)
    fitted = model.fit(train, trees=12, depth=6)
    flat = forest.of_table(forest.flatten(fitted))
    assert len({n.tree for n in flat.nodes}) == 12
    both = model.apply_model(fitted, test).select("url", F.col("prediction").alias("p"), F.col("confidence").alias("c")).join(
        model.apply_model(flat, test), "url"
    )
    got = both.collect()
    assert len(got) == test.count() and all(abs(r.c - r.confidence) < 1e-12 for r in got)
    # A tie of both classes may fall to either side by rounding.
    assert all(r.p == r.prediction or abs(r.c - 0.5) < 1e-12 for r in got)
    for name, used in flat.importances().items():
        assert (used > 0) >= (model.importances(fitted).filter(F.col("feature") == name).first().importance > 0)


def test_random_trees_equal_plain_ones(spark, rows):
    made = forest.fit_random_trees(rows, trees=5, depth=3, seed=9)
    plain = [r.asDict() for r in rows.collect()]
    low = {f: min(r[f] for r in plain) for f in FEATURES}
    high = {f: max(r[f] for r in plain) for f in FEATURES}

    def leaf(row, tree):
        at = 1
        while at < 8:
            name, step = forest.random_split(tree, at, 9)
            at = 2 * at + (row[name] > low[name] + (high[name] - low[name]) * step / 16)
        return at

    n = [sum(r["label"] == c for r in plain) for c in (0, 1)]
    counts = {}
    for row in plain:
        for tree in range(5):
            counts.setdefault((tree, leaf(row, tree)), [0, 0])[row["label"]] += 1

    def share(tree, at):
        zeros, ones = counts.get((tree, at), (0, 0))
        a, b = zeros / n[0], ones / n[1]
        return int(1024 * b / (a + b)) / 1024 if a + b else 0.5

    for r in model.apply_model(made, rows).collect():
        p = sum(share(tree, leaf(r, tree)) for tree in range(5)) / 5
        assert r.prediction == int(p > 0.5) and abs(r.confidence - max(p, 1 - p)) < 1e-12
    # No shuffle of rows: leaves are counted before the exchange, scores are a projection.
    plain_rows = spark.createDataFrame(rows.collect(), rows.schema)
    plan = model.apply_model(made, plain_rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_random_trees_without_rows_and_with_one_class(spark, rows):
    empty = forest.fit_random_trees(rows.filter("label > 5"))
    scored = model.apply_model(empty, rows.limit(3)).collect()
    assert {(r.prediction, r.confidence) for r in scored} == {(0, 0.5)}
    ones = forest.fit_random_trees(rows.filter("label = 1"))
    assert {n.share for n in ones.nodes if n.share is not None} <= {0.5, 1.0}
    too_many = forest.Forest(made_nodes(forest.MAX_NODES + 1))
    with pytest.raises(ValueError, match="nodes"):
        too_many.probability()


def made_nodes(n):
    return tuple(forest.Node(0, k, None, None, None, None, 0.5) for k in range(n))


def test_saved_forest_and_train_job(spark, rows, tmp_path):
    made = forest.fit_random_trees(rows, trees=3, depth=2)
    made.save(spark, str(tmp_path / "m"))
    assert forest.load(spark, str(tmp_path / "m")).nodes == tuple(sorted(made.nodes, key=lambda x: (x.tree, x.node)))

    def run(*argv):
        args = jobs.parser().parse_args([str(a) for a in argv])
        args.run(spark, args)

    sinks.write_version(rows.select("url", "label"), str(tmp_path / "table"))
    view(spark, SF, "dns_snapshot").write.parquet(str(tmp_path / "dns"))
    run("train", "--input", tmp_path / "table", "--dns", tmp_path / "dns", "--model", tmp_path / "trees", "--random-trees", 4)
    run("score", "--url", "http://a.example.com/x", "--model", tmp_path / "trees", "--dns", tmp_path / "dns", "--out", tmp_path / "out")
    scored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(scored) == 1 and scored[0].result in ("Phishing", "Legitimate")


def constant(share):
    return forest.Forest((forest.Node(0, 1, None, None, None, None, share),))


def test_a_repeat_gets_the_stored_answer_after_a_model_change(spark, tmp_path):
    start, hour = datetime(2024, 1, 1), timedelta(hours=1)
    dns = spark.createDataFrame([("a.com", 1), ("a.com", 0)], "host string, resolved int")
    paths = [str(tmp_path / name) for name in ("answers", "log", "checkpoint")]
    pick = random.Random(2)
    hot = [(100 + i, 1, start + timedelta(seconds=pick.randrange(3000)), "http://hot.com/") for i in range(500)]
    batches = [
        (0.875, [(1, 1, start, "http://a.com/"), (2, 1, start + hour / 2, "http://a.com/"), (3, 1, start, "http://[bad"), *hot[:250]]),
        (0.25, [(4, 1, start + hour * 0.9, "http://a.com/"), (5, 1, start + hour, "http://a.com/"), (6, 1, start - hour, "http://a.com/"),
                (7, 1, start + hour * 0.9, "http://b.com/"), (8, 1, None, "http://a.com/"), *hot[250:]]),
    ]
    for share, rows in batches:
        spark.createDataFrame(rows, REQUESTS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = serve.read_requests(spark, str(tmp_path / "in"))
        serve.stream_score(stream, constant(share), dns, *paths).awaitTermination()
    got = {r.event_id: r for r in sinks.read_table(spark, paths[0]).collect()}
    assert len(got) == 508
    # 4 repeats 1 within its hour; 5 is fresh again; 6 came late and repeats; 7 is new; 8 has no time.
    assert [got[k].result for k in (1, 2, 4, 5, 6, 7, 8)] == [
        "Phishing", "Phishing", "Phishing", "Legitimate", "Phishing", "Legitimate", "Legitimate",
    ]
    assert got[4].probability == 0.875 and got[4].confidence == 87.5 and not got[4].fresh and got[5].fresh and not got[6].fresh
    assert got[3].result == "Error" and got[3].confidence == 0
    assert {got[h[0]].result for h in hot} == {"Phishing"} and sum(got[h[0]].fresh for h in hot) == 1
    log = sinks.read_table(spark, paths[1])
    assert log.count() == sum(r.fresh and r.result != "Error" for r in got.values())
