"""Features, lookups, feature store, training set."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.catalogue import sqltext as sql
from urlrisk.catalogue.fixtures import oracle, view
from urlrisk.catalogue.prepare_queries import clean
from urlrisk.catalogue.registry import query
from urlrisk.functions import urls
from urlrisk.operators import dedupe, lookups, normalize
from urlrisk.schema import FEATURES, LEXICAL_FEATURES, PRECOMPUTED_FEATURES

AS_OF = "2024-01-01"


@query(
    oracle(
        "dirty_urls",
        f"SELECT page_id, url, {sql.features()}, {sql.STATUS} FROM ({sql.split('dirty_urls')}) x",
    )
)
def url_features(spark, sf_dir):
    return urls.url_features(view(spark, sf_dir, "dirty_urls"))


@query(
    oracle(
        "dirty_urls dns_snapshot",
        f"SELECT page_id, url, {sql.features()}, {sql.STATUS}, {sql.DNS} FROM ({sql.split('dirty_urls')}) x",
    )
)
def url_features_dns(spark, sf_dir):
    return lookups.extract(
        view(spark, sf_dir, "dirty_urls"), view(spark, sf_dir, "dns_snapshot"), ["page_id"]
    )


@query(
    oracle(
        "dirty_urls",
        """SELECT page_id, url FROM x WHERE status = 'failed'""",
        {"x": f"SELECT page_id, url, {sql.STATUS} FROM ({sql.split('dirty_urls')}) s"},
    )
)
def failed_urls(spark, sf_dir):
    return lookups.failed(url_features(spark, sf_dir)).select("page_id", "url")


@query(
    oracle(
        "registration_snapshot",
        f"""SELECT page_id, url, CAST(date_diff('day', created, DATE '{AS_OF}') AS INT) AS domain_age_days
        FROM base LEFT JOIN registration_snapshot USING (host)""",
    )
)
def domain_age(spark, sf_dir):
    pages = view(spark, sf_dir, "base").select("page_id", "url")
    aged = lookups.with_domain_age(pages, view(spark, sf_dir, "registration_snapshot"), AS_OF, ["page_id"])
    return aged.select("page_id", "url", "domain_age_days")


def precomputed(spark, sf_dir):
    table = view(spark, sf_dir, "precomputed").withColumnsRenamed(
        {"having_at": "having_@_symbol", "has_dash_in": "prefix_suffix_seperation"}
    )
    return normalize.rename_precomputed(table)


_GIVEN = {
    "given": """SELECT url, long_url AS url_length, having_at AS has_at, has_dash_in AS has_dash,
      sub_domains AS has_subdomain FROM precomputed WHERE sub_domains IS NOT NULL"""
}
_PRECOMPUTED_VIEWS = f"{sql.SOURCE_VIEWS} precomputed"
_CLEAN_GIVEN = {**sql.CLEAN, **_GIVEN}


@query(oracle("precomputed", "SELECT * FROM given", _GIVEN))
def rename_precomputed(spark, sf_dir):
    return precomputed(spark, sf_dir)


@query(
    oracle(
        _PRECOMPUTED_VIEWS,
        "SELECT url, label FROM clean WHERE url NOT IN (SELECT url FROM given)",
        _CLEAN_GIVEN,
    )
)
def anti_precomputed(spark, sf_dir):
    return lookups.without_precomputed(clean(spark, sf_dir), precomputed(spark, sf_dir))


@query(oracle(_PRECOMPUTED_VIEWS, "SELECT * FROM given WHERE url IN (SELECT url FROM clean)", _CLEAN_GIVEN))
def semi_precomputed(spark, sf_dir):
    return lookups.precomputed_in(precomputed(spark, sf_dir), clean(spark, sf_dir))


TABLE_VIEWS = f"{_PRECOMPUTED_VIEWS} dns_snapshot"
_ALL = ", ".join(FEATURES)
GIVEN_FIRST = {
    **_CLEAN_GIVEN,
    "extracted": f"SELECT url, label, {sql.features()}, {sql.DNS}, {sql.STATUS} FROM ({sql.split('clean')}) s",
    "feature_rows": f"""SELECT url, label, {', '.join(
        f'coalesce(g.{name}, e.{name}) AS {name}' if name in PRECOMPUTED_FEATURES else f'e.{name} AS {name}'
        for name in FEATURES)}
      FROM extracted e LEFT JOIN given g USING (url) WHERE status = 'ok'""",
}


@query(oracle(TABLE_VIEWS, f"SELECT url, {_ALL} FROM feature_rows", GIVEN_FIRST))
def feature_table(spark, sf_dir):
    return _features_of(spark, sf_dir, clean(spark, sf_dir))


def _features_of(spark, sf_dir, labelled):
    table = lookups.feature_table(
        labelled.select("url"), precomputed(spark, sf_dir), view(spark, sf_dir, "dns_snapshot")
    )
    return table.select("url", *FEATURES)


@query(oracle(TABLE_VIEWS, f"SELECT url, label, {_ALL} FROM feature_rows", GIVEN_FIRST))
def training_set(spark, sf_dir):
    labelled = clean(spark, sf_dir)
    return lookups.training_set(_features_of(spark, sf_dir, labelled), labelled)


@query(
    oracle(
        _PRECOMPUTED_VIEWS,
        f"""SELECT url, {', '.join(LEXICAL_FEATURES)}, CAST(0 AS INT) AS dns_record
        FROM extracted WHERE url NOT IN (SELECT url FROM given)
        UNION ALL SELECT url, {', '.join(
            name if name in PRECOMPUTED_FEATURES else f'CAST(0 AS INT) AS {name}' for name in FEATURES)}
        FROM given WHERE url IN (SELECT url FROM clean)""",
        {**_CLEAN_GIVEN, "extracted": f"SELECT url, {sql.features()} FROM ({sql.split('clean')}) s"},
    )
)
def features_union(spark, sf_dir):
    """Extracted rows without the DNS column stacked on precomputed ones."""
    labelled, given = clean(spark, sf_dir), precomputed(spark, sf_dir)
    extracted = urls.url_features(lookups.without_precomputed(labelled, given).select("url")).drop("status")
    lacking = extracted.withColumn("dns_record", F.lit(None).cast("int"))
    return lookups.features_union(lacking, lookups.precomputed_in(given, labelled))


# The feature store holds the labelled pages, with a value no extraction gives.
_STORE = {
    "store": f"""SELECT url, {sql.features({"url_length": "1000 + length(url)"})}, {sql.DNS},
      CAST(1 AS BIGINT) AS version FROM ({sql.split("(SELECT url FROM base WHERE in_labels) b")}) s""",
}


def store(spark, sf_dir):
    pages = view(spark, sf_dir, "base").filter("in_labels").select("url")
    rows = lookups.extract(pages, view(spark, sf_dir, "dns_snapshot"), ["url"]).drop("status")
    return rows.withColumn("url_length", F.col("url_length") + 1000).withColumn(
        "version", F.lit(1).cast("bigint")
    )


def _looked_up(spark, sf_dir):
    return lookups.cache_lookup(
        view(spark, sf_dir, "requests").select("event_id", "url"),
        store(spark, sf_dir),
        view(spark, sf_dir, "dns_snapshot"),
        ["event_id"],
    )


_LOOKED_UP = {
    **_STORE,
    "asked": f"""SELECT event_id, url, {sql.features()}, {sql.DNS}, {sql.STATUS} FROM (
      {sql.split("(SELECT event_id, url FROM requests) r")}) s""",
}


@query(
    oracle(
        "dns_snapshot requests",
        f"""SELECT event_id, url, s.version IS NOT NULL AS hit, {', '.join(
            f'CASE WHEN s.version IS NOT NULL THEN s.{name} ELSE a.{name} END AS {name}' for name in FEATURES)},
          status FROM asked a LEFT JOIN store s USING (url)""",
        _LOOKED_UP,
    )
)
def cache_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)


@query(
    oracle(
        "base requests",
        """SELECT count(*) AS n_requests, count(*) FILTER (WHERE in_labels) AS n_hits,
          CAST(count(*) FILTER (WHERE in_labels) AS DOUBLE) / count(*) AS hit_ratio
        FROM requests JOIN base USING (url)""",
    )
)
def cache_hit_ratio(spark, sf_dir):
    return lookups.hit_ratio(_looked_up(spark, sf_dir))


@query(
    oracle(
        "dns_snapshot",
        """SELECT url, url_length, dns_record, version FROM (
          SELECT url, url_length, dns_record, version FROM store UNION ALL
          SELECT url, CAST(length(url) AS INT), NULL, 2 FROM base WHERE scheme = 'https') x
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC) = 1""",
        _STORE,
    )
)
def cache_upsert(spark, sf_dir):
    """Version 1 rows of the store, replaced where a https page was seen again."""
    old = store(spark, sf_dir).select("url", "url_length", "dns_record", "version")
    new = view(spark, sf_dir, "base").filter("scheme = 'https'").select(
        "url",
        F.length("url").alias("url_length"),
        F.lit(None).cast("int").alias("dns_record"),
        F.lit(2).cast("bigint").alias("version"),
    )
    return dedupe.upsert(old, new)
