"""Column names, feature order and table schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The twelve model inputs. The order is the training column order.
LEXICAL_FEATURES = [
    "url_length",
    "has_ip",
    "https",
    "num_dots",
    "num_slashes",
    "has_at",
    "has_dash",
    "has_query",
    "domain_length",
    "tld_length",
    "has_subdomain",
]
FEATURES = LEXICAL_FEATURES + ["dns_record"]

# Columns of the structured source that already hold features, and the names
# the rest of the pipeline uses for them.
PRECOMPUTED_RENAMES = {
    "long_url": "url_length",
    "having_@_symbol": "has_at",
    "prefix_suffix_seperation": "has_dash",
    "sub_domains": "has_subdomain",
}
PRECOMPUTED_FEATURES = ["url_length", "has_at", "has_dash", "has_subdomain"]

CLASS_CAP = 18_000
SEED = 42
CACHE_TTL_SECONDS = 3600
LINK_CAP = 50
REQUESTS_PER_SECOND = 10
REQUESTS_PER_MINUTE = 100
# ----------------------------------------------------------------------------

# Which copy of a URL survives when sources overlap: the lowest number.
SOURCE_PRIORITY = {"structured": 1, "flat": 2, "ranked": 3}

LABELLED = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("url", T.StringType()),
    ]
)
