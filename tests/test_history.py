"""Histories: what a run adds, repeated runs, joins without a shuffle of the history, two expansions."""

from pyspark.sql import functions as F

from urlrisk.catalogue.fixtures import STATUS_SQL, view
from urlrisk.operators import links
from urlrisk.plans import forest, jobs
from urlrisk.sources import history, sinks

SF = "/root/testdata/sf0.01"


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "netloc string")


def held(known):
    return sorted((r.netloc, r.run) for r in known.read().collect())


def test_runs_add_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "RUNS", 4)
    known = history.History(spark, str(tmp_path / "h"), "netloc", buckets=3)
    assert known.read().count() == 0 and known.lacking(keys(spark, "a")).count() == 1
    known.add(keys(spark, "a", "b", "a", None), "1")
    known.add(keys(spark, "b", "c"), "2")
    known.add(keys(spark, "b", "c"), "2")
    assert held(known) == [("a", "1"), ("b", "1"), ("c", "2")]
    again = history.History(spark, str(tmp_path / "h"), "netloc")
    again.add(keys(spark, "d"), "3")  # the fourth run: merged into one file per bucket
    assert held(again) == held(known) == [("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")]
    state = history.manifest.load(spark, str(tmp_path / "h"))[1]
    files = list((tmp_path / "h" / state["folder"]).glob("*.parquet"))
    assert len(files) <= 3 and state["runs"] == ["3"]
    again.add(keys(spark, *(f"k{n}" for n in range(100))), "5")
    assert [r.netloc for r in again.lacking(keys(spark, "k7", "new")).collect()] == ["new"]


def test_a_join_does_not_shuffle_the_history(spark, tmp_path):
    known = history.History(spark, str(tmp_path / "h"), "netloc", buckets=16)
    known.add(spark.range(5000).select(F.col("id").cast("string").alias("netloc")), "1")
    found = spark.range(900).select(F.col("id").alias("seed_ord"), F.lit("l").alias("link"), F.col("id").cast("string").alias("netloc"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = links.new_domains(found, known.read())
        plan = new._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        ours, theirs = join.split("+- Sort", 1) if join.count("Exchange") == 0 else (join, join[join.rindex("Sort [netloc"):])
        assert "Exchange" not in theirs and "Bucketed: true" in theirs, plan
        assert new.count() == 0 and known.lacking(found.withColumn("netloc", F.concat("netloc", F.lit("x")))).count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_two_expansions_give_no_domain_twice(spark, tmp_path):
    pages = view(spark, SF, "rich_pages")
    parts = [pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")]
    forest.Forest((forest.Node(0, 1, None, None, None, None, 0.25),)).save(spark, str(tmp_path / "model"))
    view(spark, SF, "dns_snapshot").write.parquet(str(tmp_path / "dns"))
    found = [links.found_links(part) for part in parts]
    spark.sql("WITH links AS (SELECT * FROM {links}) " + STATUS_SQL, links=links.distinct_links(pages)).write.parquet(
        str(tmp_path / "statuses")
    )
    for n, part in enumerate(parts):
        part.write.parquet(str(tmp_path / f"pages{n}"))

    def run(n):
        argv = ["expand-links", "--no-cap", "--history", "history", "--statuses", "statuses", "--model", "model", "--dns", "dns",
                "--pages", f"pages{n}", "--out", "out", "--rejects", "rejects"]
        args = jobs.parser().parse_args([a if a.startswith("-") or k in (0,) else str(tmp_path / a) for k, a in enumerate(argv)])
        args.run(spark, args)

    def domains():
        rows = sinks.read_table(spark, str(tmp_path / "out")).select(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("d"))
        return sorted(r.d for r in rows.collect())

    run(0)
    first = domains()
    run(0)  # the same run: its own domains are not visited ones, its rows replace themselves
    assert domains() == first and len(first) == len(set(first)) > 0
    run(1)
    both = domains()
    assert len(both) == len(set(both)) and set(first) <= set(both)
    met = {r.netloc for part in found for r in part.select("netloc").collect()}
    known = history.History(spark, str(tmp_path / "history"), "netloc")
    assert {r.netloc for r in known.read().collect()} == met
    rejects = spark.read.parquet(str(tmp_path / "rejects"))
    assert rejects.select("run").distinct().count() == 2
