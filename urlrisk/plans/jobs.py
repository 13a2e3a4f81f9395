"""Command line: ``python -m urlrisk.plans.jobs <job> ...`` (or spark-submit).

Tables are the versioned folders of :mod:`urlrisk.sources.sinks`; snapshots
(``--dns``, ``--statuses``, ``--visited``, ``--pages``) are plain Parquet.
"""

from __future__ import annotations

import argparse
import hashlib
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import schema
from urlrisk.functions.urls import url_features
from urlrisk.operators import dedupe, links, lookups, quality
from urlrisk.operators.metrics import decode_scores, score_errors
from urlrisk.operators.normalize import normalize_ranked, rename_precomputed, reconstruct_url, top_domains
from urlrisk.operators.sample import balanced_sample
from urlrisk.plans import expand, forest, model as fitted, prepare, scoring
from urlrisk.session import build_session, materialize
from urlrisk.sources import readers, sinks
from urlrisk.sources.history import History
from urlrisk.streaming import reports, serve

logger = logging.getLogger(__name__)


def run_prepare(spark: SparkSession, args) -> None:
    sources = prepare.Sources(
        structured=readers.read_optional(
            spark, args.structured,
            readers.text_schema("protocol", "domain_name", "address", "is_phished"),
        ),
        flat=readers.read_optional(spark, args.flat, readers.text_schema("URL", "LABEL")),
        ranked=_ranked(spark, args),
    )
    audited = prepare.audited_table(sources)
    sample = balanced_sample(prepare.clean_table(audited), args.cap, args.seed)
    sinks.write_version(sample, args.out)
    if args.rejects:
        _write_rejects(quality.rejects(audited), args.rejects, args)
    dropped = materialize(quality.drop_report(audited), "drops")
    if args.reports:
        reports.add(reports.of_prepare(quality.stage_counts(audited), dropped), args.reports, 0, f"prepare-{_run_id(args)}")
    dropped.show(truncate=False)


def run_features(spark: SparkSession, args) -> None:
    """Add the features of new URLs to the append-only feature store.

    They come from a labelled table, or are the first ``--top`` rows of a ranked one.
    """
    if args.ranked:
        urls = top_domains(normalize_ranked(_ranked(spark, args)), args.top).select("url").distinct()
    else:
        urls = _table(spark, args.input).select("url").distinct()
    known, run = _known_urls(spark, args.store), f"{args.job}-{uuid.uuid4().hex}"
    if not args.refresh:
        urls = known.lacking(urls)
    rows = materialize(lookups.extract(urls, _parquet(spark, args.dns), ["url"]), "extracted")
    stamped = rows.filter("status = 'ok'").drop("status")
    sinks.append_segment(stamped.withColumn("version", F.unix_micros(F.current_timestamp())), args.store)
    # A run lost before this line adds its URLs again, as a newer version of the same rows.
    known.add(stamped, run)
    _write_failed(rows, args.rejects, args)


def run_train(spark: SparkSession, args) -> None:
    labelled = _table(spark, args.input)
    precomputed = None
    if args.precomputed:
        table = readers.read_optional(
            spark, args.precomputed, readers.text_schema("url", *schema.PRECOMPUTED_RENAMES), any_columns=True
        )
        parts = ("protocol", "domain_name", "address")
        if "url" not in table.columns and set(parts) <= set(table.columns):
            table = table.withColumn("url", reconstruct_url(*parts))
        names = table.withColumnsRenamed(schema.PRECOMPUTED_RENAMES).columns
        if {"url", *schema.PRECOMPUTED_FEATURES} <= set(names):
            precomputed = dedupe.keep_first(rename_precomputed(table), order=["row_ord"])
        else:
            logger.error("%s lacks columns; all features are extracted", args.precomputed)
    dns = _parquet(spark, args.dns)
    features = lookups.feature_table(labelled.select("url"), precomputed, dns)
    if args.rejects:
        _write_failed(url_features(labelled.select("url")), args.rejects, args)
    rows = lookups.training_set(features, labelled)
    if args.random_trees:
        trained = fitted.train_random(rows, args.random_trees)
        trained.model.save(spark, args.model)
    else:
        trained = fitted.train(rows, args.trees, args.depth)
        trained.model.write().overwrite().save(args.model)
    trained.metrics.show()
    trained.importances.orderBy(F.desc("importance")).show()


def run_score(spark: SparkSession, args) -> None:
    if args.url:
        urls = spark.createDataFrame([(args.url,)], "url STRING")
    else:
        urls = readers.read_url_lines(spark, args.input)
    store = _table(spark, args.store) if args.store else None
    urls = urls.withColumn("line", F.monotonically_increasing_id())
    if args.input:
        urls = materialize(urls, "lines")
    model, dns = forest.load(spark, args.model), _parquet(spark, args.dns)
    scored = scoring.score_urls(urls, model, dns, ["line"], store)
    if args.reports and store is not None:
        hits = lookups.store_hits(urls, store)
        reports.add(reports.of_lookups(hits), args.reports, 0, f"score-{_run_id(args)}")
    if args.log:
        # Written once: the table and the log both read it.
        scored = materialize(scored, "scores")
    if args.out:
        score_errors(scored).write.mode("errorifexists").parquet(args.out)
    else:
        score_errors(scored).show(truncate=False)
    if args.log:
        decoded = decode_scores(scored.filter("status = 'ok'"))
        sinks.write_result_log(decoded.withColumn("ts", F.current_timestamp()), args.log)


def run_stream_score(spark: SparkSession, args) -> None:
    serve.stream_score(
        serve.read_requests(spark, args.input, args.files_per_trigger, args.bytes_per_trigger, args.bodies),
        forest.load(spark, args.model),
        _parquet(spark, args.dns),
        args.answers,
        args.log,
        args.checkpoint,
        args.ttl,
        trigger={"processingTime": args.every} if args.every else None,
        counts=args.reports,
    ).awaitTermination()


def run_reports(spark: SparkSession, args) -> None:
    """The running reports as they stand: written to ``--out`` or shown."""
    found = reports.read(spark, args.reports, args.report)
    if args.out:
        found.write.mode("errorifexists").parquet(args.out)
    else:
        found.orderBy(*reports.KEYS).show(args.rows, truncate=False)


def run_expand_links(spark: SparkSession, args) -> None:
    """Label the links of new domains; every domain a run meets is visited from then on.

    With ``--history`` the visited domains are kept there between runs: those of
    this run are added at the end, reachable or not, so that a repeated or later
    run leaves them out. ``--visited`` names others, in a plain table.
    """
    pages, statuses = (_parquet(spark, path) for path in (args.pages, args.statuses))
    visited = _parquet(spark, args.visited) if args.visited else None
    kept = History(spark, args.history, "netloc") if args.history else None
    if kept is not None:
        # What this run itself has added in an earlier attempt does not count as visited.
        before = kept.read().filter(F.col("run") != _run_id(args)).select("netloc")
        visited = before if visited is None else visited.select("netloc").unionByName(before)
    if visited is None:
        visited = spark.createDataFrame([], "netloc string")
    model, dns = forest.load(spark, args.model), _parquet(spark, args.dns)
    found = materialize(links.found_links(pages), "links")
    frontier = links.crawl_frontier(found, visited, statuses, None)
    scored = materialize(expand.score_links(frontier, model, dns), "scored-links")
    labelled = expand.first_labelled(scored, None if args.no_cap else args.cap)
    if kept is None:
        sinks.append_segment(labelled, args.out)
    else:
        sinks.append_segment(labelled, args.out, 0, f"run-{_run_id(args)}")
    if args.rejects:
        dropped = (
            links.link_rejects(found, visited, statuses)
            .unionByName(links.failed_pages(pages))
            .unionByName(expand.failed_links(scored))
        )
        _write_rejects(dropped, args.rejects, args)
        # Good links without a place are in a folder of their own beside the rejects.
        _write_rejects(expand.over_cap(scored, None if args.no_cap else args.cap), args.rejects.rstrip("/") + "-over-cap", args)
    if kept is not None:
        kept.add(found.select("netloc"), _run_id(args))


def run_merge(spark: SparkSession, args) -> None:
    existing = sinks.read_table(spark, args.table)
    if existing is None:
        existing = spark.createDataFrame([], schema.LABELLED)
    incoming = sinks.read_table(spark, args.found, with_segment=True)
    if incoming is None:
        incoming = spark.createDataFrame([], schema.LABELLED).withColumn("segment", F.lit(0))
    order = ("segment", "label")
    if args.dry_run:
        dedupe.merge_report(existing, incoming, order).show()
        return
    known, run = _known_urls(spark, args.table), _run_id(args)
    # Only the found rows are shuffled. What an earlier attempt of this run has added counts as found.
    before = known.read().filter(F.col("run") != run)
    added = materialize(dedupe.new_rows(before, incoming, order).select("url", "label"), "merged")
    dedupe.size_report(existing, added).show()
    if not added.isEmpty():
        sinks.append_segment(added, args.table, 0, f"merge-{run}")
        known.add(added, run)


def _known_urls(spark: SparkSession, root: str) -> History:
    """URLs of the current version of a table, bucketed; filled from the table when it is first asked for."""
    version = (sinks.versions(spark, root) or [0])[-1]
    known = History(spark, f"{root.rstrip('/')}/_urls-{version}", "url")
    if not known.exists():
        table = sinks.read_table(spark, root)
        known.add(spark.createDataFrame([], "url string") if table is None else table, "table")
    return known


def _run_id(args) -> str:
    """Name of a run: ``--run-id``, or else what the job was called with, so the same call is the same run."""
    if args.run_id:
        return args.run_id
    given = {k: v for k, v in vars(args).items() if not callable(v)}
    return hashlib.sha256(repr(sorted(given.items())).encode()).hexdigest()[:16]


def _write_rejects(dropped: DataFrame, path: str, args) -> None:
    """Rejects of a run in a folder of its own, which a repeated run replaces."""
    stamped = dropped.withColumn("rejected_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={args.job}-{_run_id(args)}")


def _write_failed(extracted: DataFrame, path: str | None, args) -> None:
    """URLs without features, as rejects; nothing without a path."""
    if path:
        _write_rejects(lookups.failed(extracted).select("url", F.lit("no_features").alias("reason")), path, args)


def _ranked(spark: SparkSession, args) -> DataFrame:
    return readers.read_optional(
        spark, args.ranked, readers.text_schema("domain"), any_columns=True, header=not args.no_header
    )


def _table(spark: SparkSession, root: str) -> DataFrame:
    table = sinks.read_table(spark, root)
    if table is None:
        raise FileNotFoundError(f"no finished version in {root}")
    return table


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="urlrisk")
    top.add_argument(
        "--shuffle-partitions",
        help="upper bound per shuffle, about one per 128 MB of shuffled data; AQE merges small ones",
    )
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, run, *required: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--run-id", help="a run repeated under its id replaces what it has written; default: its options")
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    sub = job("prepare", run_prepare, "out")
    for option in ("structured", "flat", "ranked", "rejects"):
        sub.add_argument(f"--{option}")
    sub.add_argument("--no-header", action="store_true", help="the ranked file has no header line")
    sub.add_argument("--reports", help="running reports to add to")
    sub.add_argument("--cap", type=int, default=schema.CLASS_CAP)
    sub.add_argument("--seed", type=int, default=schema.SEED)

    sub = job("features", run_features, "store", "dns")
    source = sub.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="labelled table")
    source.add_argument("--ranked", help="ranked domains; the first --top of them")
    sub.add_argument("--top", type=int, default=1000)
    sub.add_argument("--no-header", action="store_true", help="the ranked file has no header line")
    sub.add_argument("--rejects", help="where to add URLs without features")
    sub.add_argument("--refresh", action="store_true", help="extract known URLs again")

    sub = job("train", run_train, "input", "dns", "model")
    sub.add_argument("--precomputed")
    sub.add_argument("--rejects", help="where to add URLs without features")
    sub.add_argument("--trees", type=int, default=fitted.TREES)
    sub.add_argument("--random-trees", type=int, help="grow so many randomised trees instead, in two passes")
    sub.add_argument("--depth", type=int, default=fitted.DEPTH)

    sub = job("score", run_score, "model", "dns")
    source = sub.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="text file, one URL per line")
    source.add_argument("--url")
    sub.add_argument("--store", help="feature store to look in first")
    sub.add_argument("--reports", help="running reports to add the store's hits to")
    sub.add_argument("--out")
    sub.add_argument("--log")

    sub = job("stream-score", run_stream_score, "input", "model", "dns", "answers", "log", "checkpoint")
    sub.add_argument("--ttl", type=int, default=schema.CACHE_TTL_SECONDS)
    sub.add_argument("--files-per-trigger", type=int)
    sub.add_argument("--bytes-per-trigger", type=int, default=serve.BYTES_PER_TRIGGER)
    sub.add_argument("--bodies", action="store_true", help="the input holds JSON request bodies")
    sub.add_argument("--reports", help="running reports to add to")
    sub.add_argument("--every", help="trigger interval; default: handle what is there and stop")

    sub = job("expand-links", run_expand_links, "pages", "statuses", "model", "dns", "out")
    sub.add_argument("--visited", help="table of domains to leave out")
    sub.add_argument("--history", help="visited domains, kept and added to by each run")
    sub.add_argument("--cap", type=int, default=schema.LINK_CAP)
    sub.add_argument("--no-cap", action="store_true")
    sub.add_argument("--rejects")

    sub = job("reports", run_reports, "reports")
    sub.add_argument("--report", help="one report; default: all")
    sub.add_argument("--out")
    sub.add_argument("--rows", type=int, default=1000, help="rows to show")

    sub = job("merge", run_merge, "table", "found")
    sub.add_argument("--dry-run", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    size = {"spark.sql.shuffle.partitions": args.shuffle_partitions} if args.shuffle_partitions else {}
    args.run(build_session(f"urlrisk {args.job}", **size), args)


if __name__ == "__main__":
    main()
