"""Three source shapes to one: source, src_priority, row_ord, url, label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.labels import vocabulary_label, yes_no_label
from urlrisk.functions.urls import ensure_scheme, strip
from urlrisk.schema import PRECOMPUTED_FEATURES, PRECOMPUTED_RENAMES, SOURCE_PRIORITY


def reconstruct_url(protocol: str, domain: str, address: str) -> Column:
    """Join the parts, collapse runs of slashes, restore ``://`` after every colon."""
    joined = F.concat(
        strip(F.coalesce(F.col(protocol), F.lit("http"))),
        F.lit("://"),
        strip(F.coalesce(F.col(domain), F.lit(""))),
        F.lit("/"),
        strip(F.coalesce(F.col(address), F.lit(""))),
    )
    single = F.regexp_replace(joined, "//+", "/")
    return F.nullif(F.replace(single, F.lit(":/"), F.lit("://")), F.lit("http://"))


def normalize_structured(df: DataFrame) -> DataFrame:
    url = reconstruct_url("protocol", "domain_name", "address")
    return _shape(df, "structured", url, yes_no_label("is_phished"))


def normalize_flat(df: DataFrame) -> DataFrame:
    require_columns(df, ["URL", "LABEL"])
    return _shape(df, "flat", ensure_scheme("URL"), vocabulary_label("LABEL"))


def normalize_ranked(df: DataFrame, column: str | None = None) -> DataFrame:
    """Every listed domain is legitimate. A blank or missing one has no URL."""
    domain = strip(column or domain_column(df))
    url = F.when(domain != "", F.concat(F.lit("https://"), domain))
    return _shape(df, "ranked", url, F.lit(0))


def top_domains(ranked: DataFrame, n: int) -> DataFrame:
    """The first ``n`` URLs of a normalised ranked source, as a feature store is warmed with."""
    return ranked.filter("url IS NOT NULL").select("row_ord", "url").orderBy("row_ord", "url").limit(n)


def domain_column(df: DataFrame) -> str:
    """``domain`` if there is one, else the first data column."""
    names = [name for name in df.columns if name != "row_ord"]
    return "domain" if "domain" in names else names[0]


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def rename_precomputed(df: DataFrame) -> DataFrame:
    """Precomputed features under their canonical names, complete rows only.

    A row position is kept, to pick the first row of a repeated URL.
    """
    renamed = df.withColumnsRenamed(PRECOMPUTED_RENAMES)
    require_columns(renamed, ["url", *PRECOMPUTED_FEATURES])
    return renamed.select(
        "url",
        *[F.col(name).try_cast("double").try_cast("int").alias(name) for name in PRECOMPUTED_FEATURES],
        *[name for name in df.columns if name == "row_ord"],
    ).na.drop()


def _shape(df: DataFrame, source: str, url: Column, label: Column) -> DataFrame:
    return df.select(
        F.lit(source).alias("source"),
        F.lit(SOURCE_PRIORITY[source]).alias("src_priority"),
        "row_ord",
        url.alias("url"),
        label.cast("int").alias("label"),
    )
