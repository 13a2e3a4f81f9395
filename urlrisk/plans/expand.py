"""Found links to new labelled rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.links import crawl_frontier
from urlrisk.plans.forest import Forest
from urlrisk.plans.scoring import score_urls
from urlrisk.schema import LINK_CAP


def score_links(frontier: DataFrame, model: PipelineModel | Forest, dns: DataFrame) -> DataFrame:
    """The frontier with ``url``, ``label`` and ``status``; a failed link has no label."""
    scored = score_urls(frontier.withColumnRenamed("link", "url"), model, dns)
    return scored.withColumnRenamed("prediction", "label").drop("confidence")


def pseudo_label(frontier: DataFrame, model: PipelineModel | Forest, dns: DataFrame) -> DataFrame:
    """Label each link with the model; links without features are left out."""
    return score_links(frontier, model, dns).filter("status = 'ok'").select("url", "label")


def first_labelled(scored: DataFrame, cap: int | None = LINK_CAP) -> DataFrame:
    """The first ``cap`` links in seed order that got a label: a failed link takes no place."""
    labelled = scored.filter("status = 'ok'")
    if cap is not None:
        labelled = labelled.orderBy("seed_ord", "url").limit(cap)
    return labelled.select("url", "label")


def over_cap(scored: DataFrame, cap: int | None = LINK_CAP) -> DataFrame:
    """Labelled links after the first ``cap`` in seed order, as rejects: what :func:`first_labelled` leaves out."""
    labelled = scored.filter("status = 'ok'")
    if cap is None:
        return labelled.limit(0).select("seed_ord", "url", F.lit("over_cap").alias("reason"))
    first = labelled.orderBy("seed_ord", "url").limit(cap)
    first = first.select(F.col("seed_ord").alias("_seed"), F.col("url").alias("_url"))
    same = F.col("seed_ord").eqNullSafe(F.col("_seed")) & F.col("url").eqNullSafe(F.col("_url"))
    return labelled.join(first, same, "left_anti").select("seed_ord", "url", F.lit("over_cap").alias("reason"))


def failed_links(scored: DataFrame) -> DataFrame:
    """Links of the frontier without features, as rejects."""
    return scored.filter("status = 'failed'").select("seed_ord", "url", F.lit("no_features").alias("reason"))


def expand(
    links: DataFrame,
    visited: DataFrame,
    statuses: DataFrame,
    model: PipelineModel | Forest,
    dns: DataFrame,
    cap: int | None = LINK_CAP,
) -> DataFrame:
    return first_labelled(score_links(crawl_frontier(links, visited, statuses, None), model, dns), cap)
