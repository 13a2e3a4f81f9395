"""Labelled sources to a clean, balanced (url, label) table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from urlrisk.operators.dedupe import keep_first
from urlrisk.operators.normalize import (
    normalize_flat,
    normalize_ranked,
    normalize_structured,
    union_sources,
)
from urlrisk.operators.quality import accepted, audit
from urlrisk.operators.sample import balanced_sample
from urlrisk.schema import CLASS_CAP, SEED
from urlrisk.session import materialize


@dataclass(frozen=True)
class Sources:
    structured: DataFrame
    flat: DataFrame
    ranked: DataFrame

    def audited(self) -> DataFrame:
        """All rows in one shape with the verdict on their URL."""
        return audit(
            union_sources(
                normalize_structured(self.structured),
                normalize_flat(self.flat),
                normalize_ranked(self.ranked),
            )
        )


def audited_table(sources: Sources) -> DataFrame:
    """The audited rows, written once for jobs that pass over them repeatedly."""
    return materialize(sources.audited(), "audited")


def clean_urls(audited: DataFrame) -> DataFrame:
    """Accepted rows, one per URL."""
    return keep_first(accepted(audited))


def clean_table(audited: DataFrame) -> DataFrame:
    """``(url, label)`` after de-duplication, written once: later steps read it
    several times and must not repeat the shuffle."""
    return materialize(clean_urls(audited).select("url", "label"), "clean")


def prepare(sources: Sources, cap: int = CLASS_CAP, seed: int = SEED) -> DataFrame:
    return balanced_sample(clean_table(sources.audited()), cap, seed)
