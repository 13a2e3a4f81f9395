"""Sources, normalisation, validation, quality, de-duplication, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.catalogue import sqltext as sql
from urlrisk.catalogue.fixtures import oracle, view
from urlrisk.catalogue.registry import query
from urlrisk.functions import urls
from urlrisk.functions.urls import is_valid_url, strip, with_reject_reason
from urlrisk.operators import dedupe, lookups, normalize, quality, sample
from urlrisk.plans import prepare
from urlrisk.session import new_path
from urlrisk.sources import readers, sinks
from urlrisk.streaming import serve


def sources(spark, sf_dir) -> prepare.Sources:
    return prepare.Sources(
        view(spark, sf_dir, "src_structured"),
        view(spark, sf_dir, "src_flat"),
        view(spark, sf_dir, "src_ranked"),
    )


def audited(spark, sf_dir):
    return sources(spark, sf_dir).audited()


def audited_table(spark, sf_dir):
    """For the queries that pass over the rows more than once."""
    return prepare.audited_table(sources(spark, sf_dir))


def good(spark, sf_dir):
    return quality.accepted(audited(spark, sf_dir))


def clean(spark, sf_dir):
    return prepare.clean_table(audited(spark, sf_dir))


@query(oracle(sql.SOURCE_VIEWS, "SELECT url, label FROM clean", sql.CLEAN))
def scan_processed(spark, sf_dir):
    """The processed table through a CSV file and back."""
    path = new_path(spark, "processed")
    sinks.write_csv(clean(spark, sf_dir), path)
    return readers.read_csv(spark, path).select("url", F.col("label").cast("int").alias("label"))


@query(oracle("url_lines", f"SELECT {sql.strip('value')} AS url FROM url_lines WHERE {sql.strip('value')} <> ''"))
def scan_url_lines(spark, sf_dir):
    path = new_path(spark, "lines")
    view(spark, sf_dir, "url_lines").write.text(path)
    return readers.read_url_lines(spark, path)


@query(
    oracle(
        "requests_json",
        f"SELECT page_id, CAST(position AS INT) AS position, {sql.strip('raw')} AS url FROM listed",
        {
            "listed": """SELECT page_id, unnest(v) AS raw, generate_subscripts(v, 1) - 1 AS position FROM (
              SELECT page_id, coalesce(CAST(json_extract(body, '$.urls') AS VARCHAR[]),
                [json_extract_string(body, '$.url')]) AS v FROM requests_json) s"""
        },
    )
)
def explode_requests(spark, sf_dir):
    return readers.explode_requests(view(spark, sf_dir, "requests_json"))


@query(oracle("src_structured", sql.STRUCTURED))
def normalize_structured(spark, sf_dir):
    return normalize.normalize_structured(view(spark, sf_dir, "src_structured"))


@query(oracle("src_flat", sql.FLAT))
def normalize_flat(spark, sf_dir):
    return normalize.normalize_flat(view(spark, sf_dir, "src_flat"))


@query(oracle("src_ranked", sql.RANKED))
def normalize_domains(spark, sf_dir):
    return normalize.normalize_ranked(view(spark, sf_dir, "src_ranked"))


@query(oracle(sql.SOURCE_VIEWS, "SELECT * FROM all_rows", sql.ALL_ROWS))
def union_sources(spark, sf_dir):
    src = sources(spark, sf_dir)
    return normalize.union_sources(
        normalize.normalize_structured(src.structured),
        normalize.normalize_flat(src.flat),
        normalize.normalize_ranked(src.ranked),
    )


@query(
    oracle(
        sql.SOURCE_VIEWS, "SELECT * FROM all_rows WHERE url IS NOT NULL AND label IS NOT NULL", sql.ALL_ROWS
    )
)
def drop_nulls(spark, sf_dir):
    return union_sources(spark, sf_dir).na.drop(subset=["url", "label"])


@query(
    oracle(
        sql.SOURCE_VIEWS,
        f"""SELECT source, row_ord, url, {sql.reason()} IS NULL AS valid FROM ({sql.split('all_rows')}) x""",
        sql.ALL_ROWS,
    )
)
def valid_split(spark, sf_dir):
    rows = union_sources(spark, sf_dir).select("source", "row_ord", "url")
    return rows.withColumn("valid", is_valid_url("url"))


@query(oracle("dirty_urls", f"SELECT page_id, {sql.strip('url')} AS url FROM dirty_urls"))
def strip_urls(spark, sf_dir):
    return view(spark, sf_dir, "dirty_urls").select("page_id", strip("url").alias("url"))


@query(
    oracle(
        "dirty_urls",
        f"SELECT page_id, url, {sql.reason()} IS NULL AS valid FROM ({sql.split('dirty_urls')}) x",
    )
)
def validate_urls(spark, sf_dir):
    return view(spark, sf_dir, "dirty_urls").withColumn("valid", is_valid_url("url"))


_ASSUMED = """SELECT page_id, url, CASE WHEN url = '' OR starts_with(url, 'http://')
  OR starts_with(url, 'https://') THEN url ELSE 'https://' || url END AS assumed FROM dirty_urls"""


@query(
    oracle(
        "dirty_urls",
        f"""SELECT page_id, url, {sql.reason(check_scheme=False)} IS NULL AS valid
        FROM ({sql.split('assumed_urls', 'assumed')}) x""",
        {"assumed_urls": _ASSUMED},
    )
)
def validate_urls_lenient(spark, sf_dir):
    return view(spark, sf_dir, "dirty_urls").withColumn("valid", is_valid_url("url", lenient=True))


@query(oracle("dirty_urls", f"SELECT page_id, url, {sql.reason()} AS reason FROM ({sql.split('dirty_urls')}) x"))
def reject_reasons(spark, sf_dir):
    return with_reject_reason(view(spark, sf_dir, "dirty_urls"))


@query(
    oracle("dirty_urls", f"SELECT page_id, url, scheme, netloc, path, query FROM ({sql.split('dirty_urls')}) x")
)
def url_parts(spark, sf_dir):
    return urls.url_parts(view(spark, sf_dir, "dirty_urls"))


@query(oracle(sql.SOURCE_VIEWS, "SELECT * FROM rejected", sql.REJECTS))
def rejects(spark, sf_dir):
    return quality.rejects(audited_table(spark, sf_dir))


@query(
    oracle(
        sql.SOURCE_VIEWS,
        """SELECT source, src_priority, row_ord, url, reason FROM rejected
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_ord, reason) <= 5""",
        sql.REJECTS,
    )
)
def reject_preview(spark, sf_dir):
    return quality.reject_preview(rejects(spark, sf_dir))


@query(
    oracle(
        sql.SOURCE_VIEWS,
        """SELECT source, count(*) AS rows_read,
          count(*) FILTER (WHERE reason IS NULL OR reason = 'bad_label') AS rows_valid_url,
          count(*) FILTER (WHERE reason IS NULL) AS rows_accepted FROM audited GROUP BY source""",
        sql.AUDITED,
    )
)
def stage_counts(spark, sf_dir):
    return quality.stage_counts(audited(spark, sf_dir))


@query(
    oracle(
        sql.SOURCE_VIEWS,
        "SELECT source, reason, count(*) AS n_dropped FROM rejected GROUP BY ROLLUP (source, reason)",
        sql.REJECTS,
    )
)
def drop_report(spark, sf_dir):
    return quality.drop_report(audited_table(spark, sf_dir))


@query(oracle(sql.SOURCE_VIEWS, "SELECT source, row_ord, url, label FROM clean", sql.CLEAN))
def dedupe_first(spark, sf_dir):
    return dedupe.keep_first(good(spark, sf_dir)).select("source", "row_ord", "url", "label")


@query(
    oracle(
        sql.SOURCE_VIEWS,
        "SELECT source, row_ord, url, label FROM good QUALIFY count(*) OVER (PARTITION BY url) > 1",
        sql.AUDITED,
    )
)
def duplicate_members(spark, sf_dir):
    rows = quality.accepted(audited_table(spark, sf_dir))
    return dedupe.duplicate_members(rows).select("source", "row_ord", "url", "label")


@query(
    oracle(
        sql.SOURCE_VIEWS,
        "SELECT url, count(*) AS copies FROM good GROUP BY url HAVING count(DISTINCT label) > 1",
        sql.AUDITED,
    )
)
def label_conflicts(spark, sf_dir):
    return dedupe.label_conflicts(good(spark, sf_dir))


_BALANCE = """SELECT count(*) FILTER (WHERE label = 0) AS n_legitimate,
  count(*) FILTER (WHERE label = 1) AS n_phishing,
  least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1), 18000) AS target FROM clean"""


@query(oracle(sql.SOURCE_VIEWS, _BALANCE, sql.CLEAN))
def class_balance(spark, sf_dir):
    return sample.class_balance(clean(spark, sf_dir))


_SAMPLED = {
    **sql.CLEAN,
    "balance": _BALANCE,
    "sampled": """SELECT url, label FROM clean QUALIFY row_number() OVER (
      PARTITION BY label ORDER BY md5('42|' || url), url) <= (SELECT target FROM balance)""",
}


@query(oracle(sql.SOURCE_VIEWS, "SELECT url, label FROM sampled", _SAMPLED))
def balanced_sample(spark, sf_dir):
    return prepare.prepare(sources(spark, sf_dir))


_TRAIN = "substr(md5('split|42|' || url), 1, 2) < 'cd'"


@query(oracle(sql.SOURCE_VIEWS, f"SELECT url, label, {_TRAIN} AS is_train FROM sampled", _SAMPLED))
def train_test_split(spark, sf_dir):
    return balanced_sample(spark, sf_dir).withColumn("is_train", sample.is_train())


@query(
    oracle(
        sql.SOURCE_VIEWS,
        f"""SELECT label, count(*) AS n,
          CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
        FROM clean WHERE {_TRAIN} GROUP BY label""",
        sql.CLEAN,
    )
)
def class_weights(spark, sf_dir):
    train, _ = sample.train_test_split(clean(spark, sf_dir))
    return sample.class_weights(train)


# Fewer than the tables hold, so that the limit is seen at work.
_TOP = 20


@query(
    oracle(
        "src_ranked",
        f"SELECT row_ord, url FROM ranked WHERE url IS NOT NULL ORDER BY row_ord, url LIMIT {_TOP}",
        {"ranked": sql.RANKED},
    )
)
def top_domains(spark, sf_dir):
    return normalize.top_domains(normalize_domains(spark, sf_dir), _TOP)


# The second labelled table of the merge: the flat source's rows against the
# structured ones.
_MERGE = {
    **sql.AUDITED,
    "existing": """SELECT url, label FROM good WHERE source = 'structured' QUALIFY
      row_number() OVER (PARTITION BY url ORDER BY src_priority, row_ord) = 1""",
    "added": """SELECT url, label FROM good WHERE source = 'flat'
      AND url NOT IN (SELECT url FROM existing) QUALIFY
      row_number() OVER (PARTITION BY url ORDER BY row_ord) = 1""",
}


def _merge_inputs(spark, sf_dir):
    rows = quality.accepted(audited_table(spark, sf_dir))
    existing = dedupe.keep_first(rows.filter("source = 'structured'"))
    return existing, rows.filter("source = 'flat'"), ("row_ord",)


@query(
    oracle(sql.SOURCE_VIEWS, "SELECT url, label FROM existing UNION ALL SELECT url, label FROM added", _MERGE)
)
def merge_new(spark, sf_dir):
    return dedupe.merge_new(*_merge_inputs(spark, sf_dir))


@query(
    oracle(sql.SOURCE_VIEWS, "SELECT url, label FROM existing UNION ALL SELECT url, label FROM added", _MERGE)
)
def stream_merge(spark, sf_dir):
    """The same merge with the second table as a stream."""
    existing, incoming, order = _merge_inputs(spark, sf_dir)
    source, table = new_path(spark, "incoming"), new_path(spark, "merged")
    sinks.write_version(existing.select("url", "label"), table)
    incoming.select("url", "label", *order).write.parquet(source)
    found = spark.readStream.schema(incoming.select("url", "label", *order).schema).parquet(source)
    serve.stream_merge(found, table, f"{table}-checkpoint", order).awaitTermination()
    return sinks.read_table(spark, table)


@query(
    oracle(
        sql.SOURCE_VIEWS,
        """SELECT (SELECT count(*) FROM existing) AS rows_before,
          (SELECT count(*) FROM existing) + (SELECT count(*) FROM added) AS rows_after,
          (SELECT count(*) FROM added) AS rows_new""",
        _MERGE,
    )
)
def merge_report(spark, sf_dir):
    return dedupe.merge_report(*_merge_inputs(spark, sf_dir))


@query(
    oracle(
        sql.SOURCE_VIEWS,
        """SELECT url FROM good WHERE source = 'structured' INTERSECT
        SELECT url FROM good WHERE source = 'flat'""",
        sql.AUDITED,
    )
)
def url_intersect(spark, sf_dir):
    rows = good(spark, sf_dir)
    return lookups.common_urls(rows.filter("source = 'structured'"), rows.filter("source = 'flat'"))
