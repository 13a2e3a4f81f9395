"""Links of pages, page features, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.catalogue import sqltext as sql
from urlrisk.catalogue.fixtures import STATUS_SQL, oracle, view
from urlrisk.catalogue.registry import query
from urlrisk.functions.html import page_features
from urlrisk.operators import dedupe, links
from urlrisk.session import materialize, new_path
from urlrisk.sources import history


def pages(spark, sf_dir):
    return view(spark, sf_dir, "rich_pages")


def visited(spark, sf_dir):
    return view(spark, sf_dir, "visited")


def links_table(spark, sf_dir):
    return materialize(links.found_links(pages(spark, sf_dir)), "links")


def statuses(spark, found):
    return spark.sql("WITH links AS (SELECT * FROM {found}) " + STATUS_SQL, found=found)


@query(oracle("rich_pages", "SELECT page_id, url, link_ord, href FROM hrefs", sql.HREFS))
def extract_links(spark, sf_dir):
    return links.extract_links(pages(spark, sf_dir))


@query(
    oracle(
        "rich_pages",
        "SELECT page_id, link_ord, link FROM resolved WHERE regexp_matches(link, '^(?i)http[a-z0-9+.-]*:')",
        sql.LINKS,
    )
)
def resolve_links(spark, sf_dir):
    return links.resolve_links(pages(spark, sf_dir))


@query(oracle("rich_pages", "SELECT page_id, link FROM links", sql.LINKS))
def distinct_links(spark, sf_dir):
    return links.distinct_links(pages(spark, sf_dir))


@query(
    oracle(
        "rich_pages",
        r"""SELECT s.page_id, s.url, coalesce(num_anchors, 0)::INT AS num_anchors,
          coalesce(external_anchors, 0)::INT AS external_anchors,
          coalesce(len(regexp_extract_all(body, '(?i)<form\b')), 0)::INT AS num_forms,
          CASE WHEN contains(html, 'window.open') OR contains(html, 'alert(') THEN 1 ELSE 0 END AS has_popup,
          coalesce(len(regexp_extract_all(body, '(?i)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh')), 0)::INT
            AS meta_refresh
        FROM seen s LEFT JOIN per_page USING (page_id)""",
        {
            **sql.LINKS,
            "per_page": r"""SELECT page_id, count(*) AS num_anchors, count(*) FILTER (
                WHERE regexp_extract(link, '^[^:]*://([^/?#]*)', 1) NOT IN ('', b_netloc)) AS external_anchors
              FROM resolved GROUP BY page_id""",
        },
    )
)
def html_features(spark, sf_dir):
    return page_features(pages(spark, sf_dir)).drop("html")


@query(oracle("rich_pages", "SELECT netloc, seed_ord, link FROM firsts", sql.FRONTIER))
def first_per_domain(spark, sf_dir):
    return dedupe.first_per_domain(links.found_links(pages(spark, sf_dir)))


@query(
    oracle(
        "visited rich_pages",
        "SELECT netloc, seed_ord, link FROM firsts WHERE netloc NOT IN (SELECT netloc FROM visited)",
        sql.FRONTIER,
    )
)
def new_domains(spark, sf_dir):
    return links.new_domains(links.found_links(pages(spark, sf_dir)), visited(spark, sf_dir))


# A run of the service takes LINK_CAP links; fewer, so that the limit is seen at work.
FRONTIER_CAP = 5
_STATUSES = {**sql.FRONTIER, "statuses": STATUS_SQL}


@query(
    oracle(
        "rich_pages",
        "SELECT page_id, link FROM links WHERE link IN (SELECT url FROM statuses WHERE status < 400)",
        _STATUSES,
    )
)
def reachable_links(spark, sf_dir):
    found = links_table(spark, sf_dir)
    rows = links.reachable_occurrences(found, statuses(spark, found), ["seed_ord", "link"])
    return rows.select(rows["seed_ord"].alias("page_id"), "link")


@query(
    oracle(
        "visited rich_pages",
        """SELECT seed_ord, netloc, link FROM firsts WHERE netloc NOT IN (SELECT netloc FROM visited)
          AND link IN (SELECT url FROM statuses WHERE status < 400) ORDER BY seed_ord, link"""
        + f" LIMIT {FRONTIER_CAP}",
        _STATUSES,
    )
)
def crawl_frontier(spark, sf_dir):
    found = links_table(spark, sf_dir)
    return links.crawl_frontier(found, visited(spark, sf_dir), statuses(spark, found), FRONTIER_CAP)


@query(
    oracle(
        "visited rich_pages",
        """SELECT seed_ord, link AS url, 'repeated_domain' AS reason FROM firsts
          WHERE netloc IN (SELECT netloc FROM visited)
        UNION ALL SELECT page_id, link, 'repeated_domain' FROM links l
          WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.seed_ord = l.page_id AND f.link = l.link)
        UNION ALL SELECT seed_ord, link, 'unreachable' FROM firsts
          WHERE netloc NOT IN (SELECT netloc FROM visited)
          AND link NOT IN (SELECT url FROM statuses WHERE status < 400)
        UNION ALL SELECT page_id, url, 'no_html' FROM rich_pages WHERE html IS NULL""",
        _STATUSES,
    )
)
def link_rejects(spark, sf_dir):
    found = links_table(spark, sf_dir)
    dropped = links.link_rejects(found, visited(spark, sf_dir), statuses(spark, found))
    return dropped.unionByName(links.failed_pages(pages(spark, sf_dir)))


@query(
    oracle(
        "visited rich_pages",
        """SELECT netloc, seed_ord, link, run FROM (
          SELECT *, 1 AS run FROM firsts1 UNION ALL
          SELECT *, 2 FROM firsts2 WHERE netloc NOT IN (SELECT netloc FROM firsts1)) x
        WHERE netloc NOT IN (SELECT netloc FROM visited)""",
        {
            **sql.LINKS,
            **{
                f"firsts{run}": rf"""SELECT page_id AS seed_ord, link, regexp_extract(link, '^[^:]*://([^/?#]*)', 1) AS netloc
                FROM links WHERE page_id % 2 = {run - 1} QUALIFY row_number() OVER (
                  PARTITION BY regexp_extract(link, '^[^:]*://([^/?#]*)', 1) ORDER BY page_id, link) = 1"""
                for run in (1, 2)
            },
        },
    )
)
def visited_runs(spark, sf_dir):
    """New domains of two runs, pages of even and of odd number, that share a history begun with the visited ones."""
    known = history.History(spark, new_path(spark, "history"), "netloc", buckets=8)
    known.add(visited(spark, sf_dir), "0")
    taken = None
    for run, part in ((1, "page_id % 2 = 0"), (2, "page_id % 2 = 1")):
        found = materialize(links.found_links(pages(spark, sf_dir).filter(part)), f"links-{run}")
        new = materialize(links.new_domains(found, known.read()).withColumn("run", F.lit(run)), f"new-{run}")
        known.add(found.select("netloc"), str(run))
        taken = new if taken is None else taken.unionByName(new)
    return taken.select("netloc", "seed_ord", "link", "run")
