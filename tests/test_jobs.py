"""The command-line jobs, one after the other on the same folders."""

from pyspark.sql import functions as F

from urlrisk.catalogue.fixtures import STATUS_SQL, view
from urlrisk.operators import links
from urlrisk.plans import jobs
from urlrisk.sources import readers, sinks


def test_all_jobs(spark, tmp_path, capsys):
    sf_dir = "/root/testdata/sf0.01"
    path = {name: str(tmp_path / name) for name in (
        "structured ranked flat processed rejects dns store model lines scores log pages visited statuses found "
        "requests answers streamlog checkpoint linkrejects precomputed warm failed bodies "
        "bodyanswers bodylog bodycheckpoint absent"
    ).split()}

    def run(job, **options):
        argv = [job]
        for name, value in options.items():
            argv += [f"--{name.replace('_', '-')}"] + ([] if value is True else [str(value)])
        args = jobs.parser().parse_args(argv)
        args.run(spark, args)

    for name in ("structured", "flat", "ranked"):
        view(spark, sf_dir, f"src_{name}").drop("row_ord").write.csv(path[name], header=True, escape='"')
    view(spark, sf_dir, "dns_snapshot").write.parquet(path["dns"])

    run("prepare", structured=path["structured"], flat=path["flat"], ranked=path["ranked"],
        out=path["processed"], rejects=path["rejects"])
    processed = sinks.read_table(spark, path["processed"])
    by_label = {r.label: r["count"] for r in processed.groupBy("label").count().collect()}
    assert by_label[0] == by_label[1] > 10
    assert processed.select("url").distinct().count() == processed.count()
    assert spark.read.parquet(path["rejects"]).filter("reason IS NULL OR rejected_at IS NULL").count() == 0

    run("features", input=path["processed"], store=path["store"], dns=path["dns"])
    run("features", input=path["processed"], store=path["store"], dns=path["dns"])
    assert sinks.read_table(spark, path["store"]).count() == processed.count()

    run("features", ranked=path["ranked"], top=7, store=path["warm"], dns=path["dns"], rejects=path["failed"])
    assert sinks.read_table(spark, path["warm"]).count() == 7
    assert spark.read.parquet(path["failed"]).columns == ["url", "reason", "rejected_at", "run"]
    rejected = spark.read.parquet(path["rejects"]).count()
    run("prepare", structured=path["structured"], flat=path["flat"], ranked=path["ranked"],
        out=path["processed"], rejects=path["rejects"])
    assert spark.read.parquet(path["rejects"]).count() == rejected

    given = view(spark, sf_dir, "precomputed").withColumnsRenamed(
        {"having_at": "having_@_symbol", "has_dash_in": "prefix_suffix_seperation"}
    )
    given.unionByName(given).write.csv(path["precomputed"], header=True)
    run("train", input=path["processed"], dns=path["dns"], model=path["model"], trees=10,
        precomputed=path["precomputed"])
    assert "precision" in capsys.readouterr().out

    run("train", input=path["processed"], dns=path["dns"], model=path["model"], trees=10,
        precomputed=path["absent"], rejects=path["failed"])

    view(spark, sf_dir, "url_lines").write.text(path["lines"])
    run("score", model=path["model"], dns=path["dns"], input=path["lines"], out=path["scores"], log=path["log"])
    scores = spark.read.parquet(path["scores"])
    assert scores.count() == spark.read.text(path["lines"]).filter("trim(value) <> ''").count()
    assert spark.read.text(path["log"]).count() == scores.filter("error IS NULL").count()
    run("score", model=path["model"], dns=path["dns"], url="https://example.com", store=path["store"])
    assert "https://example.com" in capsys.readouterr().out

    pages = view(spark, sf_dir, "rich_pages")
    pages.write.parquet(path["pages"])
    view(spark, sf_dir, "visited").write.parquet(path["visited"])
    spark.sql("WITH links AS (SELECT * FROM {links}) " + STATUS_SQL, links=links.distinct_links(pages)).write.parquet(
        path["statuses"]
    )
    run("expand-links", pages=path["pages"], visited=path["visited"], statuses=path["statuses"],
        model=path["model"], dns=path["dns"], out=path["found"], cap=5,
        rejects=path["linkrejects"])
    found = sinks.read_table(spark, path["found"])
    assert found.count() == 5
    reasons = {r.reason for r in spark.read.parquet(path["linkrejects"]).select("reason").distinct().collect()}
    assert reasons == {"repeated_domain", "unreachable", "no_html"}

    before = processed.count()
    run("merge", table=path["processed"], found=path["absent"])
    run("merge", table=path["processed"], found=path["found"], dry_run=True)
    assert sinks.read_table(spark, path["processed"]).count() == before
    run("merge", table=path["processed"], found=path["found"])
    run("merge", table=path["processed"], found=path["found"])
    added = found.join(processed, "url", "left_anti").count()
    assert sinks.read_table(spark, path["processed"]).count() == before + added

    view(spark, sf_dir, "requests").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path["requests"])
    run("stream-score", input=path["requests"], model=path["model"], dns=path["dns"], answers=path["answers"],
        log=path["streamlog"], checkpoint=path["checkpoint"])
    assert sinks.read_table(spark, path["answers"]).count() == 10_000

    bodies = view(spark, sf_dir, "requests_json").select(
        F.col("page_id").alias("event_id"), F.lit(1).cast("long").alias("user_id"),
        F.current_timestamp().alias("ts"), "body",
    )
    bodies.write.parquet(path["bodies"])
    run("stream-score", input=path["bodies"], bodies=True, model=path["model"], dns=path["dns"],
        answers=path["bodyanswers"], log=path["bodylog"], checkpoint=path["bodycheckpoint"])
    answers = sinks.read_table(spark, path["bodyanswers"])
    assert answers.count() == readers.explode_requests(bodies).count() > bodies.count()
    assert answers.filter("url = ''").count() == answers.filter("result = 'Error' AND url = ''").count() > 0
