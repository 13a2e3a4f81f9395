"""Grow the data set from the links of stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.html import hrefs, with_links
from urlrisk.functions.urls import split_url
from urlrisk.operators.dedupe import first_per_domain
from urlrisk.operators.skew import ROWS_PER_TASK, lookup_join
from urlrisk.schema import LINK_CAP
from urlrisk.session import materialize


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` of every page, in page order."""
    return pages.select("page_id", "url", F.posexplode(hrefs("html")).alias("link_ord", "href"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """Extracted links as absolute http(s) URLs."""
    found = with_links(pages).select("page_id", F.posexplode("links.link").alias("link_ord", "link"))
    return found.filter("link IS NOT NULL")


def distinct_links(pages: DataFrame) -> DataFrame:
    """Absolute http(s) links, one row per page and link; made distinct in the row."""
    per_page = F.array_distinct(F.filter("links.link", lambda link: link.isNotNull()))
    return with_links(pages).select("page_id", F.explode(per_page).alias("link"))


def failed_pages(pages: DataFrame) -> DataFrame:
    """Pages without text: no links, one reject each."""
    return pages.filter("html IS NULL").select(
        F.col("page_id").alias("seed_ord"), "url", F.lit("no_html").alias("reason")
    )


def found_links(pages: DataFrame) -> DataFrame:
    """``(seed_ord, link, netloc)``: what the operators below start from.

    Reading the pages is the expensive part, so a job with several uses of the
    links writes this table once.
    """
    return distinct_links(pages).select(
        F.col("page_id").alias("seed_ord"), "link", split_url("link").netloc.alias("netloc")
    )


def new_domains(links: DataFrame, visited: DataFrame) -> DataFrame:
    """First link of each authority that no earlier run has visited.

    Taking the first per authority before the anti join gives the same rows as
    the other order and leaves one row per authority to join.
    """
    return first_per_domain(links).join(visited.select("netloc"), "netloc", "left_anti")


def _answered(statuses: DataFrame) -> DataFrame:
    return statuses.filter("status < 400").select(F.col("url").alias("link"))


def reachable(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Unique links that answered with a status below 400; no answer is unreachable."""
    return links.join(_answered(statuses), "link", "left_semi")


def unreachable(links: DataFrame, statuses: DataFrame) -> DataFrame:
    return links.join(_answered(statuses), "link", "left_anti")


def reachable_occurrences(
    links: DataFrame, statuses: DataFrame, row_id: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``reachable`` for a stored link table, where one link may sit on a third of all pages."""
    return lookup_join(links, _answered(statuses), "link", row_id, "left_semi", rows_per_task)


def crawl_frontier(
    links: DataFrame, visited: DataFrame, statuses: DataFrame, cap: int | None = LINK_CAP
) -> DataFrame:
    """New reachable links in seed order, at most ``cap``.

    A domain whose first link is down is skipped, not retried with its second.
    """
    found = reachable(new_domains(links, visited), statuses).select("seed_ord", "netloc", "link")
    return found if cap is None else found.orderBy("seed_ord", "link").limit(cap)


def link_rejects(links: DataFrame, visited: DataFrame, statuses: DataFrame) -> DataFrame:
    """What the frontier leaves out of a stored link table: ``(seed_ord, url, reason)``.

    The later links of an authority are found by their position, so no task
    holds all links of one.
    """
    firsts = materialize(first_per_domain(links), "firsts")
    known = visited.select("netloc")
    later = links.join(firsts, ["seed_ord", "link"], "left_anti")
    seen = firsts.join(known, "netloc", "left_semi")
    down = unreachable(firsts.join(known, "netloc", "left_anti"), statuses)

    def rows(df: DataFrame, reason: str) -> DataFrame:
        return df.select("seed_ord", F.col("link").alias("url"), F.lit(reason).alias("reason"))

    return (
        rows(later, "repeated_domain")
        .unionByName(rows(seen, "repeated_domain"))
        .unionByName(rows(down, "unreachable"))
    )
