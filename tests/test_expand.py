"""Every labelled link is in the output of an expansion or among its rejects."""

import pytest

from urlrisk.plans import expand, jobs


def scored_links(spark):
    rows = [(k % 4, f"http://h{k}.net/", float(k % 2), "failed" if k % 5 == 0 else "ok") for k in range(20)]
    return spark.createDataFrame(rows, "seed_ord long, url string, label double, status string").repartition(3)


@pytest.mark.parametrize("cap", [0, 5, 16, 50, None])
def test_links_over_the_cap_are_rejects(spark, cap):
    scored = scored_links(spark)
    labelled = sorted((r.seed_ord, r.url) for r in scored.filter("status = 'ok'").collect())
    found = {r.url for r in expand.first_labelled(scored, cap).collect()}
    beyond = sorted((r.seed_ord, r.url, r.reason) for r in expand.over_cap(scored, cap).collect())
    assert found == {url for _, url in labelled[:cap]}
    assert beyond == [(seed, url, "over_cap") for seed, url in ([] if cap is None else labelled[cap:])]


def test_the_job_writes_them(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rejects = spark.createDataFrame([], "seed_ord long, url string, reason string")
    monkeypatch.setattr(jobs, "_parquet", lambda spark, path: pages)
    monkeypatch.setattr(jobs.forest, "load", lambda spark, path: None)
    for name in ("found_links", "crawl_frontier", "link_rejects", "failed_pages"):
        monkeypatch.setattr(jobs.links, name, lambda *given: rejects)
    monkeypatch.setattr(jobs.expand, "score_links", lambda *given: scored_links(spark))
    names = [x for n in ("pages", "visited", "statuses", "model", "dns") for x in (f"--{n}", n)]
    args = jobs.parser().parse_args(["expand-links", *names, "--out", f"{tmp_path}/out", "--cap", "5", "--rejects", f"{tmp_path}/rejects/"])
    args.run(spark, args)
    beyond = spark.read.parquet(f"{tmp_path}/rejects-over-cap")
    assert beyond.columns == ["seed_ord", "url", "reason", "rejected_at", "run"] and beyond.count() == 11
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 4
