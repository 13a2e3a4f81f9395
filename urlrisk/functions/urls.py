"""URL splitting, validation and lexical features as column expressions.

Everything here is a composition of built-in functions, so a scan, the split
and all features run in one code-generated stage without Python workers.

The splitting rules are those of a lenient splitter (scheme up to the first
colon, authority after ``//`` up to ``/ ? #``), not of a strict RFC parser:
``parse_url`` raises or returns null for inputs that must still be scored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.schema import LEXICAL_FEATURES

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"(?s)^[^#]*#(.*)\z"
PARAMS = r";([^/]*)\z"

# Dotted names need one label per dot and a last label of letters only. Empty
# labels are excluded by a separate test for "..", which keeps the pattern free
# of repeated groups (those recurse per label in the JVM).
DOTTED_NAME = r"^[a-zA-Z0-9-][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}\z"
DOTTED_QUAD = r"^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\z"
# The whole validity rule on the cleaned text: web scheme, then an accepted
# authority up to its end. One pattern, used once, so that a filter on it can be
# pushed to the scan without copying the split.
VALID = (
    r"^(?i:https?)://(?:(?![^/?#]*\.\.)[a-zA-Z0-9-][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}"
    r"|(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3})(?:[/?#]|\z)"
)
ALL_DIGITS = r"^\p{Nd}+\z"
BRACKETED_HOST = r"^([^\[\]]*@)?\[[0-9a-fA-F:.]+\](:.*)?\z"

# --- fixed values -----------------------------------------------------------
# Characters a string strip removes, characters dropped in front of a URL, and
# characters removed anywhere in a URL before it is split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LEADING_JUNK = "".join(chr(code) for code in range(0x21))
INNER_JUNK = "\t\r\n"
# Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
# ----------------------------------------------------------------------------


def strip(col: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(_col(col), F.lit(WHITESPACE))


def clean(col: Column | str) -> Column:
    """What the splitter sees: no leading controls or spaces, no tab, CR, LF."""
    return F.translate(F.ltrim(_col(col), F.lit(LEADING_JUNK)), INNER_JUNK, "")


@dataclass(frozen=True)
class UrlColumns:
    """The parts of one URL column; ``raw`` is the untouched text."""

    raw: Column
    scheme: Column
    netloc: Column
    full_path: Column
    query: Column
    fragment: Column

    @property
    def host(self) -> Column:
        """Lower-cased authority, port and userinfo included."""
        return F.lower(self.netloc)

    @property
    def has_params(self) -> Column:
        return self.scheme.isin(PARAM_SCHEMES)

    @property
    def path(self) -> Column:
        """Path without the ``;params`` of its last segment."""
        return F.when(self.has_params, F.regexp_replace(self.full_path, PARAMS, "")).otherwise(self.full_path)

    @property
    def params(self) -> Column:
        return F.when(self.has_params, F.regexp_extract(self.full_path, PARAMS, 1)).otherwise("")

    @property
    def malformed(self) -> Column:
        """Brackets in the authority that do not hold an IPv6 literal."""
        return malformed_host(self.netloc)

    @property
    def parsable(self) -> Column:
        return F.coalesce((self.raw != "") & ~self.malformed, F.lit(False))


def split_url(url: Column | str) -> UrlColumns:
    """The parts as expressions. For several uses of the same URL see ``staged``."""
    return split_clean(_col(url), clean(url))


def split_clean(raw: Column, text: Column) -> UrlColumns:
    return UrlColumns(
        raw=raw,
        scheme=F.lower(F.regexp_extract(text, SCHEME, 1)),
        netloc=F.regexp_extract(text, NETLOC, 1),
        full_path=F.regexp_extract(text, PATH, 1),
        query=F.regexp_extract(text, QUERY, 1),
        fragment=F.regexp_extract(text, FRAGMENT, 1),
    )


def staged(df: DataFrame, url: str = "url", prefix: str = "_url_") -> tuple[DataFrame, UrlColumns]:
    """``df`` with the parts as columns of their own, and these columns.

    The parts sit in a projection below their uses, so each pattern runs once
    per row however often a part is used; parts nobody uses are pruned.
    """
    names = {name: prefix + name for name in ("scheme", "netloc", "full_path", "query", "fragment")}
    text = prefix + "text"
    parts = split_clean(F.col(url), F.col(text))
    wide = df.withColumn(text, clean(url)).withColumns(
        {column: getattr(parts, name) for name, column in names.items()}
    )
    return wide, UrlColumns(raw=F.col(url), **{name: F.col(column) for name, column in names.items()})


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    wide, parts = staged(df, url)
    return wide.select(
        *df.columns,
        parts.scheme.alias("scheme"),
        parts.netloc.alias("netloc"),
        parts.path.alias("path"),
        parts.query.alias("query"),
    )


def reject_reason(parts: UrlColumns, check_scheme: bool = True) -> Column:
    """Why a URL is not accepted; null for a valid one."""
    reason = F.when(parts.raw.isNull() | (parts.raw == ""), "null_url")
    if check_scheme:
        reason = reason.when(~parts.scheme.isin("http", "https"), "bad_scheme")
    return (
        reason.when(parts.netloc == "", "no_host")
        .when(parts.netloc.rlike(ALL_DIGITS), "numeric_host")
        .when(~_accepted_host(parts.netloc), "bad_host")
    )


def with_reject_reason(
    df: DataFrame, url: str = "url", lenient: bool = False, name: str = "reason"
) -> DataFrame:
    """Add the reject reason of ``url``.

    With ``lenient`` a missing ``http(s)://`` is assumed and the scheme itself
    is not checked.
    """
    if lenient:
        wide, parts = staged(df.withColumn("_assumed", ensure_scheme(url)), "_assumed")
    else:
        wide, parts = staged(df, url)
    return wide.select(*df.columns, reject_reason(parts, not lenient).alias(name))


def is_valid_url(url: Column | str, lenient: bool = False) -> Column:
    """Web scheme and a dotted name or dotted quad as authority; never null."""
    text = ensure_scheme(url) if lenient else _col(url)
    return F.coalesce(clean(text).rlike(VALID), F.lit(False))


def ensure_scheme(url: Column | str) -> Column:
    """Prefix ``https://`` unless the text starts with ``http(s)://`` (case matters)."""
    raw = _col(url)
    has_scheme = raw.startswith("http://") | raw.startswith("https://")
    return F.when(has_scheme | (raw == ""), raw).otherwise(F.concat(F.lit("https://"), raw))


def malformed_host(netloc: Column) -> Column:
    return netloc.rlike(r"[\[\]]") & ~netloc.rlike(BRACKETED_HOST)


def _accepted_host(netloc: Column) -> Column:
    dotted_name = netloc.rlike(DOTTED_NAME) & ~F.contains(netloc, F.lit(".."))
    return dotted_name | netloc.rlike(DOTTED_QUAD)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


Feature = Callable[[UrlColumns], Column]

_LEXICAL: dict[str, Feature] = {
    "url_length": lambda u: F.length(u.raw),
    "has_ip": lambda u: _flag(u.host.rlike(DOTTED_QUAD)),
    "https": lambda u: _flag(u.scheme == "https"),
    "num_dots": lambda u: _occurrences(u.host, "."),
    "num_slashes": lambda u: _occurrences(u.raw, "/"),
    "has_at": lambda u: _flag(F.contains(u.raw, F.lit("@"))),
    "has_dash": lambda u: _flag(F.contains(u.host, F.lit("-"))),
    "has_query": lambda u: _flag(u.query != ""),
    "domain_length": lambda u: F.length(u.host),
    "tld_length": lambda u: F.when(
        F.contains(u.host, F.lit(".")), F.length(F.substring_index(u.host, ".", -1))
    ).otherwise(0),
    "has_subdomain": lambda u: _flag(_occurrences(u.host, ".") > 1),
}


@dataclass(frozen=True)
class FeatureSet:
    """Named features over :class:`UrlColumns`; extend it with ``with_feature``."""

    features: Mapping[str, Feature]

    def with_feature(self, name: str, feature: Feature) -> FeatureSet:
        return FeatureSet({**self.features, name: feature})

    def columns(self, parts: UrlColumns) -> list[Column]:
        """One integer column per feature, null where the URL cannot be split."""
        return [
            F.when(parts.parsable, feature(parts)).cast("int").alias(name)
            for name, feature in self.features.items()
        ]


LEXICAL = FeatureSet({name: _LEXICAL[name] for name in LEXICAL_FEATURES})


def url_features(
    df: DataFrame, url: str = "url", features: FeatureSet = LEXICAL, keep_host: bool = False
) -> DataFrame:
    """Append the features and ``status`` (``ok`` or ``failed``); narrow projections.

    ``keep_host`` adds ``host``, for a lookup that follows.
    """
    wide, parts = staged(df, url)
    status = F.when(parts.parsable, "ok").otherwise("failed").alias("status")
    host = [parts.host.alias("host")] if keep_host else []
    return wide.select(*df.columns, *features.columns(parts), status, *host)


def register_sql_functions(spark) -> None:
    """Make the splitter and the validity test callable from SQL.

    The bodies are SQL expressions, so the optimizer inlines them.
    """
    junk = "".join(f"\\u{code:04x}" for code in range(0x21))
    text = f"translate(trim(LEADING '{junk}' FROM u), '\\t\\r\\n', '')"
    bodies = {
        "url_scheme": ("STRING", f"lower(regexp_extract({text}, r'{SCHEME}', 1))"),
        "url_netloc": ("STRING", f"regexp_extract({text}, r'{NETLOC}', 1)"),
        "url_path": ("STRING", f"regexp_extract({text}, r'{PATH}', 1)"),
        "url_query": ("STRING", f"regexp_extract({text}, r'{QUERY}', 1)"),
        "is_valid_url": ("BOOLEAN", f"coalesce({text} RLIKE r'{VALID}', false)"),
    }
    for name, (returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u STRING) RETURNS {returns} RETURN {body}")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
