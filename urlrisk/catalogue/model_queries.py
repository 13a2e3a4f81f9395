"""Queries with a model: the fitted forest, whose fit no SQL expresses, and randomised trees, which SQL can grow."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from urlrisk.catalogue import sqltext as sql
from urlrisk.catalogue.feature_queries import GIVEN_FIRST, TABLE_VIEWS, training_set
from urlrisk.catalogue.fixtures import STATUS_SQL, oracle, view
from urlrisk.catalogue.link_queries import FRONTIER_CAP, links_table, statuses, visited
from urlrisk.catalogue.registry import query
from urlrisk.catalogue.request_queries import FRESH, add_files, request_files
from urlrisk.operators.sample import balanced_sample
from urlrisk.operators.skew import lookup_join
from urlrisk.plans import expand, forest, model, scoring
from urlrisk.schema import CLASS_CAP, FEATURES, LINK_CAP, REQUESTS, SEED
from urlrisk.session import materialize, new_path
from urlrisk.sources.sinks import read_table
from urlrisk.streaming import reports, serve


def trained(spark, sf_dir) -> model.Trained:
    """One fit per session and data folder, shared by the queries below."""
    return _trained(spark.sparkContext.applicationId, sf_dir)


@lru_cache(maxsize=4)
def _trained(_app: str, sf_dir: str) -> model.Trained:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return model.train(balanced_sample(training_set(spark, sf_dir)))


@query()
def train_score(spark, sf_dir):
    """Train on the balanced sample; accuracy, precision and recall on the test part."""
    return trained(spark, sf_dir).metrics


_TRAIN = f"substr(md5('split|{SEED}|' || url), 1, 2) < 'cd'"
_SAMPLED = {
    **GIVEN_FIRST,
    "balance": f"""SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1), {CLASS_CAP}) AS target FROM feature_rows""",
    "sampled": f"""SELECT * FROM feature_rows QUALIFY row_number() OVER (
      PARTITION BY label ORDER BY md5('{SEED}|' || url), url) <= (SELECT target FROM balance)""",
}


@query(
    oracle(
        TABLE_VIEWS,
        f"""SELECT count(*) FILTER ({_TRAIN}) AS n_train, count(*) FILTER ({_TRAIN} AND label = 1) AS n_train_phishing,
          count(*) FILTER (NOT {_TRAIN}) AS n_test, {len(FEATURES)} AS n_features, {model.TREES} AS n_trees FROM sampled""",
        _SAMPLED,
    )
)
def train_summary(spark, sf_dir):
    """What the forest was fitted on and how large it is: the part of the fit that does not depend on its chances."""
    return trained(spark, sf_dir).summary


@query(
    oracle(
        TABLE_VIEWS,
        """SELECT count(*) AS n, tp, fp, fn, CAST(sum(CAST(label = prediction AS INT)) AS DOUBLE) / count(*) AS accuracy,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall
        FROM (SELECT *, count(*) FILTER (label = 1 AND prediction = 1) OVER () AS tp,
          count(*) FILTER (label = 0 AND prediction = 1) OVER () AS fp,
          count(*) FILTER (label = 1 AND prediction = 0) OVER () AS fn FROM test JOIN scored USING (url)) x GROUP BY tp, fp, fn""",
        {
            **_SAMPLED,
            "train": f"SELECT * FROM sampled WHERE {_TRAIN}",
            "test": f"SELECT * FROM sampled WHERE NOT {_TRAIN}",
            **sql.forest("test", "train", "url"),
        },
    )
)
def train_random(spark, sf_dir):
    """Randomised trees grown on the train part of the balanced sample, measured on the rest."""
    return model.train_random(balanced_sample(training_set(spark, sf_dir))).metrics


@query()
def feature_importance(spark, sf_dir):
    return trained(spark, sf_dir).importances


def random_trees(spark, sf_dir, seed: int = SEED) -> forest.Forest:
    """One forest per session, data folder and seed, over the whole training set."""
    return _random_trees(spark.sparkContext.applicationId, sf_dir, seed)


@lru_cache(maxsize=8)
def _random_trees(_app: str, sf_dir: str, seed: int) -> forest.Forest:
    from pyspark.sql import SparkSession

    return forest.fit_random_trees(materialize(training_set(SparkSession.active(), sf_dir), "training-set"), seed=seed)


# What the trees are grown from, and the features of some rows as the trees want them.
_MODEL_VIEWS = TABLE_VIEWS
_ALL = ", ".join(FEATURES)


def _with_features(rel: str, keep: str) -> str:
    return f"SELECT {keep}, {sql.features()}, {sql.DNS}, {sql.STATUS} FROM ({sql.split(rel)}) s"


_SCORED = {
    **GIVEN_FIRST,
    "asked": _with_features("dirty_urls", "page_id, url"),
    "usable": "SELECT * FROM asked WHERE status = 'ok'",
    **sql.forest("usable", "feature_rows", "page_id"),
}


@query(
    oracle(
        f"dirty_urls {_MODEL_VIEWS}",
        "SELECT page_id, url, prediction, confidence, status FROM asked LEFT JOIN scored USING (page_id)",
        _SCORED,
    )
)
def score_urls(spark, sf_dir):
    """Prediction and confidence of every URL, nulls where its features failed."""
    return scoring.score_urls(
        view(spark, sf_dir, "dirty_urls"), random_trees(spark, sf_dir),
        view(spark, sf_dir, "dns_snapshot"), ["page_id"],
    )


@query()
def score_fitted(spark, sf_dir):
    """The same with the forest that the library fits."""
    return scoring.score_urls(
        view(spark, sf_dir, "dirty_urls"), trained(spark, sf_dir).model,
        view(spark, sf_dir, "dns_snapshot"), ["page_id"],
    )


@query(
    oracle("dirty_urls", f"SELECT page_id, url, {sql.STATUS} FROM ({sql.split('dirty_urls')}) x")
)
def score_status(spark, sf_dir):
    """Which URLs get a score: the part of ``score_fitted`` that does not depend on the fit."""
    return score_fitted(spark, sf_dir).select("page_id", "url", "status")


@query(
    oracle(
        "visited rich_pages",
        """SELECT link AS url FROM firsts WHERE netloc NOT IN (SELECT netloc FROM visited)
          AND link IN (SELECT url FROM statuses WHERE status < 400) ORDER BY seed_ord, link"""
        + f" LIMIT {FRONTIER_CAP}",
        {**sql.FRONTIER, "statuses": STATUS_SQL},
    )
)
def labelled_links(spark, sf_dir):
    """The links an expansion labels, without their labels; resolved links all have features."""
    found = links_table(spark, sf_dir)
    labelled = expand.expand(
        found, visited(spark, sf_dir), statuses(spark, found),
        trained(spark, sf_dir).model, view(spark, sf_dir, "dns_snapshot"), FRONTIER_CAP,
    )
    return labelled.filter(labelled["label"].isin(0, 1)).select("url")


@query(
    oracle(
        f"visited rich_pages {_MODEL_VIEWS}",
        f"""SELECT url, prediction AS label FROM (SELECT seed_ord, url, prediction
          FROM usable JOIN scored USING (seed_ord, url) ORDER BY seed_ord, url LIMIT {LINK_CAP}) x""",
        {
            **sql.FRONTIER,
            "statuses": STATUS_SQL,
            **GIVEN_FIRST,
            "frontier": """SELECT seed_ord, link AS url FROM firsts WHERE netloc NOT IN (SELECT netloc FROM visited)
              AND link IN (SELECT url FROM statuses WHERE status < 400)""",
            "asked": _with_features("frontier", "seed_ord, url"),
            "usable": "SELECT * FROM asked WHERE status = 'ok'",
            **sql.forest("usable", "feature_rows", "seed_ord, url"),
        },
    )
)
def pseudo_label(spark, sf_dir):
    """Labels of the first new reachable links, by randomised trees."""
    found = links_table(spark, sf_dir)
    return expand.expand(
        found, visited(spark, sf_dir), statuses(spark, found),
        random_trees(spark, sf_dir), view(spark, sf_dir, "dns_snapshot"),
    )


_ANSWERED = {
    **FRESH,
    **GIVEN_FIRST,
    "asked": _with_features("(SELECT DISTINCT url FROM requests) r", "url"),
    "usable": "SELECT * FROM asked WHERE status = 'ok'",
    **sql.forest("usable", "feature_rows", "url"),
}
_ANSWER = """CASE WHEN prediction = 1 THEN 'Phishing' WHEN prediction = 0 THEN 'Legitimate' ELSE 'Error' END AS result,
  coalesce(round(confidence * 100, 2), 0) AS confidence,
  CASE WHEN prediction IS NULL THEN 'Unable to verify this URL' END AS error, confidence AS probability"""


def _served(spark, sf_dir, files: str, out: str, seed: int = SEED, counts: str | None = None):
    serve.stream_score(
        serve.read_requests(spark, files), random_trees(spark, sf_dir, seed), view(spark, sf_dir, "dns_snapshot"),
        f"{out}/answers", f"{out}/log", f"{out}/checkpoint", counts=counts,
    ).awaitTermination()
    return read_table(spark, f"{out}/answers")


@query(
    oracle(
        f"requests {_MODEL_VIEWS}",
        f"SELECT event_id, user_id, ts, url, fresh, {_ANSWER} FROM walk LEFT JOIN scored USING (url)",
        _ANSWERED,
        recursive=True,
    )
)
def stream_score(spark, sf_dir):
    """The whole request table as a stream of files: answers with their log flag."""
    return _served(spark, sf_dir, request_files(spark, sf_dir), new_path(spark, "stream"))


def _in_halves(spark, sf_dir, out: str, seeds: tuple[int, int], counts: str | None = None):
    """The requests streamed in two runs, by time, each with trees of its own seed: all answers, and where the second began."""
    ts = F.col("ts").cast("timestamp")
    requests = view(spark, sf_dir, "requests").withColumn("ts", ts).select(*REQUESTS.names)
    requests = materialize(requests, "request-table")
    micros = F.unix_micros("ts")
    ends = requests.agg(F.min(micros), F.max(micros)).first()
    half = (ends[0] + ends[1]) // 2
    files = new_path(spark, "requests")
    for early, seed in zip((True, False), seeds, strict=True):
        rows = requests.filter((micros < half) == F.lit(early))
        add_files(rows, files, rows.count(), 2)
        served = _served(spark, sf_dir, files, out, seed, counts)
    return served, half


# Grows the trees that replace the first ones in the middle of the stream.
_LATER_SEED = SEED + 1


@query(
    oracle(
        f"requests {_MODEL_VIEWS}",
        f"""SELECT event_id, url, fresh, anchor < half AS first_model, {_ANSWER}
        FROM walk CROSS JOIN halves LEFT JOIN (SELECT *, true AS early FROM scored UNION ALL SELECT *, false FROM scored2) s
          ON s.url = walk.url AND s.early = (anchor < half)""".replace("event_id, url,", "event_id, walk.url AS url,"),
        {
            **_ANSWERED,
            **sql.forest("usable", "feature_rows", "url", _LATER_SEED, "2"),
            "halves": "SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS half FROM requests",
        },
        recursive=True,
    )
)
def stream_answers(spark, sf_dir):
    """Answers of a stream whose model is replaced half way: what repeats gets the answer of its first request."""
    served, half = _in_halves(spark, sf_dir, new_path(spark, "stream"), (SEED, _LATER_SEED))
    # The anchor is the last fresh request of the URL, this one included: of the first model from the first fresh
    # request on, until one of the second half is fresh. Two requests of a URL tell, so its others need no order.
    at = F.struct("ts", "event_id")
    fresh = served.filter("fresh").groupBy("url").agg(
        F.min(at).alias("_first"), F.min(F.when(F.unix_micros("ts") >= half, at)).alias("_later")
    )
    joined = lookup_join(served, fresh, "url", ["event_id"])
    first_model = F.when(at >= F.col("_later"), False).when(at >= F.col("_first"), True)
    return joined.select(
        "event_id", "url", "fresh", first_model.alias("first_model"), "result", "confidence", "error", "probability"
    )


_BY = "GROUP BY 1, 2, 3, 4"
_WINDOWED = "CAST(NULL AS VARCHAR) AS source, "


@query(
    oracle(
        f"requests {_MODEL_VIEWS}",
        f"""SELECT 'rate_second' AS report, date_trunc('second', ts) AS window_start, {_WINDOWED}
          CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(0 AS BIGINT) AS hits FROM requests {_BY}
        UNION ALL SELECT 'rate_minute', date_trunc('minute', ts), {_WINDOWED} CAST(user_id AS VARCHAR), count(*), 0 FROM requests {_BY}
        UNION ALL SELECT 'predictions_hourly', date_trunc('hour', ts), {_WINDOWED}
          CASE WHEN prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END, count(*), 0
          FROM walk JOIN scored USING (url) WHERE fresh {_BY}
        UNION ALL SELECT 'requests_hourly', date_trunc('hour', ts), {_WINDOWED} 'answers', count(*),
          count(*) FILTER (NOT fresh) FROM walk {_BY}""",
        _ANSWERED,
        recursive=True,
    )
)
def running_reports(spark, sf_dir):
    """The reports that a stream over the whole request table leaves, stopped and started again half way."""
    out = new_path(spark, "stream")
    _in_halves(spark, sf_dir, out, (SEED, SEED), f"{out}/reports")
    return reports.read(spark, f"{out}/reports")
