"""Readers, versioned tables, logs."""

import logging
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from urlrisk.operators.dedupe import keep_first
from urlrisk.session import materialize, new_path, shared_dir
from urlrisk.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_text_columns_and_missing_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'URL,LABEL\na.com,good\n"b.com/?x=""1"",2",NA\n,1\nnull,nan\n')
    rows = readers.read_csv(spark, path).orderBy("row_ord").collect()
    assert [(r.URL, r.LABEL) for r in rows] == [("a.com", "good"), ('b.com/?x="1",2', None), (None, "1"), (None, None)]


def test_csv_record_over_several_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'URL,LABEL\n"a.com/\nb",good\nc.com,bad\n')
    rows = readers.read_csv(spark, path).orderBy("row_ord").collect()
    assert [(r.URL, r.LABEL) for r in rows] == [("a.com/\nb", "good"), ("c.com", "bad")]
    assert not readers._files_with_open_quotes(spark, write(tmp_path / "b.csv", 'x\n"a ""quoted"" word"\n'))


def test_one_odd_file_leaves_the_others_split(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    write(folder / "a b.csv", 'URL,LABEL\n"a.com/\nb",good\nz.com,bad\n')
    write(folder / "c.csv", "URL,LABEL\n" + "".join(f"u{i}.com,1\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        table = readers.read_csv(spark, str(folder))
        assert table.rdd.getNumPartitions() > 8
        rows = table.orderBy("row_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.URL for r in rows] == ["a.com/\nb", "z.com", *(f"u{i}.com" for i in range(3000))]


def test_file_order_survives_splits(spark, tmp_path):
    lines = ["url,label"] + [f"u{i % 700},{i}" for i in range(5000)]
    path = write(tmp_path / "a.csv", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = readers.read_csv(spark, path)
        assert table.rdd.getNumPartitions() > 10
        got = {r.url: int(r.label) for r in keep_first(table.repartition(7), order=("row_ord",)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"u{i}": i for i in range(700)}


def test_file_without_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", "google.com\na.com\n")
    assert [r._c0 for r in readers.read_csv(spark, path, header=False).collect()] == ["google.com", "a.com"]


def test_optional_and_required_sources(spark, tmp_path, caplog):
    schema = readers.text_schema("URL", "LABEL")
    with caplog.at_level(logging.WARNING):
        absent = readers.read_optional(spark, str(tmp_path / "none.csv"), schema)
    assert absent.count() == 0 and absent.schema == schema and "not found" in caplog.text
    assert readers.read_optional(spark, None, schema).count() == 0
    with pytest.raises(AnalysisException):
        readers.read_required(spark, str(tmp_path / "none.csv"))
    other = write(tmp_path / "b.csv", "site\na.com\n")
    assert readers.read_optional(spark, other, schema).count() == 0
    assert readers.read_optional(spark, other, schema, any_columns=True).count() == 1
    present = readers.read_csv(spark, write(tmp_path / "a.csv", "URL,LABEL\na.com,good\n"))
    assert present.unionByName(absent).count() == 1


def test_url_lines(spark, tmp_path):
    path = write(tmp_path / "urls.txt", "http://a.com\n\n  \thttp://b.com  \n   \n")
    assert sorted(r.url for r in readers.read_url_lines(spark, path).collect()) == ["http://a.com", "http://b.com"]


def test_request_bodies(spark):
    bodies = ['{"url": " a "}', '{"urls": ["b", " c "]}', '{"urls": "d", "url": "e"}', '{"x": 1}', "no json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id INT, body STRING")
    got = sorted((r.id, r.position, r.url) for r in readers.explode_requests(df).collect())
    assert got[:3] == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")]
    assert [(i, u) for i, _, u in got[4:]] == [(3, None), (4, None), (5, None)]


def test_versions_and_segments(spark, tmp_path):
    root = str(tmp_path / "table")
    assert sinks.read_table(spark, root) is None
    sinks.write_version(spark.range(3), root)
    sinks.append_segment(spark.range(3, 5), root)
    assert sinks.read_table(spark, root).count() == 5
    sinks.append_segment(spark.range(10, 14), root, segment=7)
    sinks.append_segment(spark.range(10, 12), root, segment=7)
    assert sinks.read_table(spark, root).count() == 7
    assert sinks.read_table(spark, root, below_segment=7).count() == 5
    numbered = sinks.read_table(spark, root, with_segment=True).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in numbered} == {0: 3, 1: 2, 7: 2}
    # A rewrite may read the version it replaces.
    sinks.write_version(sinks.read_table(spark, root).filter("id > 1"), root)
    assert sorted(r.id for r in sinks.read_table(spark, root).collect()) == [2, 3, 4, 10, 11]
    (tmp_path / "table" / "data" / "unfinished").mkdir(parents=True)
    assert sinks.versions(spark, root) == [0, 1]
    # Segment 7 is in the rewritten version; a late repeat of it adds nothing, a new number does.
    sinks.append_segment(spark.range(10, 14), root, segment=7)
    assert sinks.read_table(spark, root).count() == 5
    sinks.append_segment(spark.range(20, 21), root, segment=5)
    assert sinks.read_table(spark, root).count() == 6


def test_segments_are_merged_and_the_list_stays_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FAN", 3)
    root = str(tmp_path / "table")
    for n in range(30):
        sinks.append_segment(spark.range(n, n + 1), root, segment=n, writer="a" if n % 2 else "b")
    state = sinks.manifest.load(spark, root)[1]
    assert len(state["segments"]) <= 2 * 4
    assert sorted(r.id for r in sinks.read_table(spark, root).collect()) == list(range(30))
    numbered = sinks.read_table(spark, root, with_segment=True).collect()
    assert all(r.id == r.segment for r in numbered)
    # Repeated batches, merged or not, change nothing; their own rows can be left out.
    for n in (0, 13, 29):
        sinks.append_segment(spark.range(n, n + 1), root, segment=n, writer="a" if n % 2 else "b")
    assert sinks.read_table(spark, root).count() == 30
    left = sinks.read_table(spark, root, below_segment=11, writer="a")
    assert sorted(r.id for r in left.collect()) == [n for n in range(30) if n % 2 == 0 or n < 11]
    manifests = list((tmp_path / "table" / "_manifests").glob("0*.json"))
    assert len(manifests) <= sinks.manifest.KEPT + 1


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FAN", 4)
    root = str(tmp_path / "table")

    def write(name):
        for n in range(6):
            sinks.append_segment(spark.range(1).selectExpr(f"'{name}{n}' AS x"), root, segment=n, writer=name)
            sinks.append_segment(spark.range(1).selectExpr(f"'{name}any{n}' AS x"), root)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, ["p", "q", "r"]))
    got = sorted(r.x for r in sinks.read_table(spark, root).collect())
    assert got == sorted(f"{name}{kind}{n}" for name in "pqr" for kind in ("", "any") for n in range(6))


def test_result_log(spark, tmp_path):
    path = str(tmp_path / "log")
    results = spark.sql("SELECT 'http://a.com' AS url, 'phishing' AS prediction, timestamp'2024-01-02 03:04:05' AS ts")
    sinks.write_result_log(results.limit(0), path)
    sinks.write_result_log(results, path)
    sinks.write_result_log(results, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["http://a.com - phishing - 2024-01-02 03:04:05"] * 2


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert new_path(spark, "x") != new_path(spark, "x")
    table = materialize(spark.range(5).withColumn("x", F.lit(1)), "t")
    assert table.count() == 5 and "Range" not in table._jdf.queryExecution().executedPlan().toString()
