"""Links and page features from raw HTML, without Python workers.

Works on the whole page text. Comments, scripts and styles are removed first;
then each ``<a>`` start tag is cut out and its last ``href`` taken.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.urls import PARAMS, UrlColumns, clean, malformed_host, split_clean, staged

# An unclosed one hides the rest of the page.
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script[^>]*>|\z)|style\b.*?(?:</style[^>]*>|\z))"
)

# What may stand in a start tag: space, stray quoted text, or a name with or without a
# value. Outside of quotes a new tag ends it. All repetitions are possessive, so the JVM
# engine runs them as loops, whatever the number of attributes.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_NAMED = rf"""[^\s/>=<"']++(?:\s*+=\s*+(?:{_QUOTED}|[^\s>"'][^\s>]*+))?+"""
ANCHOR = rf"(?i)<a(?=[\s/])(?:[\s/=]++|{_QUOTED}|{_NAMED})*+"
ATTRIBUTE = rf"{_QUOTED}|{_NAMED}"
HREF = r"(?i)^href\s*=\s*"

FORM = r"(?i)<form\b"
POPUP = ("window.open", "alert(")
META_REFRESH = r"""(?i)<meta\b[^<>]*http-equiv\s*=\s*["']?refresh"""

REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def visible(html: str | Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(_col(html), HIDDEN, "")


def hrefs(html: str | Column) -> Column:
    """All ``<a href>`` values of a page in page order; empty for a null page."""
    return _visible_hrefs(visible(html))


def _visible_hrefs(text: Column) -> Column:
    def last_href(tag: Column) -> Column:
        attributes = F.regexp_extract_all(F.substr(tag, F.lit(3)), F.lit(ATTRIBUTE), F.lit(0))
        return F.try_element_at(F.filter(attributes, lambda item: item.rlike(HREF)), F.lit(-1))

    raw = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0)), last_href), lambda item: item.isNotNull()
    )
    values = F.transform(raw, lambda item: unescape(_unquote(F.regexp_replace(item, HREF, ""))))
    return F.coalesce(values, F.array().cast("array<string>"))


def _unquote(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def unescape(text: Column) -> Column:
    """Decode the ``;``-terminated character references of one string.

    The text is cut at each ``&``; a piece that starts with a known reference
    has it replaced, any other piece keeps its ampersand.
    """
    pieces = F.split(text, "&")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(F.concat(F.lit("&"), piece), "^" + REFERENCE, 1)
        character = F.when(name == "", None).when(name.startswith("#"), _numeric(name)).otherwise(
            F.try_element_at(_named_references(), name)
        )
        rest = F.substr(piece, F.length(name) + 2)
        return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), piece))

    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode)
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _numeric(name: Column) -> Column:
    is_hex = name.rlike("^#[xX]")
    given = F.regexp_replace(F.when(is_hex, F.substr(name, F.lit(3))).otherwise(F.substr(name, F.lit(2))), "^0+", "")
    # More than seven digits are beyond the last code point in either base.
    short = F.when(F.length(given) <= 7, F.concat(F.lit("0"), given))
    digits = F.when(is_hex, short).otherwise(F.conv(short, 10, 16))
    code = F.conv(digits, 16, 10).cast("int")
    legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # Controls and non-characters stand for nothing, 0x80 to 0x9F for the characters of Windows-1252.
    nothing = (
        code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    western = F.element_at(F.array(*(F.lit(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(0x80, 0xA0))), code - 0x7F)
    character = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    return (
        F.when(code.between(0x80, 0x9F), western).when(legal & nothing, "").when(legal, character).otherwise("\ufffd")
    )


def _named_references() -> Column:
    """Name to character, from the standard library's HTML5 table."""
    names = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    keys = F.split(F.lit(" ".join(names)), " ")
    values = F.split(F.lit("\u0000".join(names.values())), "\u0000")
    return F.map_from_arrays(keys, values)


def with_links(
    pages: DataFrame, url: str = "url", html: str = "html", keep_visible: bool = False
) -> DataFrame:
    """Add ``links``: each ``<a href>`` of a page as ``(href, link, netloc)``.

    ``link`` is the absolute form on the page's URL, null for a malformed one. A
    page is one row and stays one row: nothing is shuffled. Each step below is
    an array of structs built from the step before, so no part is derived twice.
    ``keep_visible`` adds ``_visible``, the page as the links saw it.
    """
    wide, base = staged(pages.withColumn("_visible", visible(html)), url, "_base_")
    folder = F.split(base.path, "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(
        F.slice(folder, F.lit(1), F.size(folder) - 1)
    )
    wide = wide.select(
        "*",
        base.path.alias("_base_path"),
        base.params.alias("_base_params"),
        folder.alias("_base_folder"),
        _visible_hrefs(F.col("_visible")).alias("_hrefs"),
    )
    steps = F.transform("_hrefs", lambda href: F.struct(href.alias("href"), clean(href).alias("text")))
    steps = F.transform(steps, _href_parts)
    steps = F.transform(steps, lambda link: _href_path(link, F.col("_base_folder")))
    steps = F.transform(steps, lambda link: _absolute(link, base))
    return wide.select(*pages.columns, *(["_visible"] if keep_visible else []), steps.alias("links"))


def _href_parts(link: Column) -> Column:
    parts = split_clean(link["href"], link["text"])
    return F.struct(
        link["href"].alias("href"),
        parts.scheme.alias("scheme"),
        parts.netloc.alias("netloc"),
        parts.full_path.alias("path"),
        parts.query.alias("query"),
        parts.fragment.alias("fragment"),
    )


def _href_path(link: Column, folder: Column) -> Column:
    """Path segments after the merge with the page's folder, and the parameters."""
    params = F.regexp_extract(link["path"], PARAMS, 1)
    path = F.regexp_replace(link["path"], PARAMS, "")
    joined = F.concat(folder, F.split(path, "/"))
    # Empty segments between the first and the last are dropped.
    inner = F.filter(
        F.slice(joined, F.lit(2), F.greatest(F.size(joined) - 2, F.lit(0))), lambda part: part != ""
    )
    relative = F.when(
        F.size(joined) > 1,
        F.concat(F.array(F.element_at(joined, 1)), inner, F.array(F.element_at(joined, -1))),
    ).otherwise(joined)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    return F.struct(
        *[link[name].alias(name) for name in ("href", "scheme", "netloc", "path", "query", "fragment")],
        params.alias("params"),
        path.alias("bare_path"),
        segments.alias("segments"),
    )


def _without_dots(segments: Column) -> Column:
    """Path text with ``.`` and ``..`` carried out; most paths have none."""
    has_dots = F.exists(segments, lambda part: part.isin(".", ".."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    tail = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    text = F.when(has_dots, F.array_join(F.concat(kept, tail), "/")).otherwise(F.array_join(segments, "/"))
    return F.regexp_replace(text, "^(?!/)", "/")


def _absolute(link: Column, base: UrlColumns) -> Column:
    has_host = link["netloc"] != ""
    no_path = link["path"] == ""
    path = (
        F.when(has_host, link["bare_path"])
        .when(no_path, F.col("_base_path"))
        .otherwise(_without_dots(link["segments"]))
    )
    inherits = no_path & ~has_host
    params = F.when(inherits, F.col("_base_params")).otherwise(link["params"])
    query = F.when(inherits & (link["query"] == ""), base.query).otherwise(link["query"])
    netloc = F.when(has_host, link["netloc"]).otherwise(base.netloc)
    joined = F.concat(
        base.scheme,
        F.lit("://"),
        netloc,
        path,
        _prefixed(";", params),
        _prefixed("?", query),
        _prefixed("#", link["fragment"]),
    )
    other_scheme = (link["scheme"] != "") & (link["scheme"] != base.scheme)
    scheme = F.when(other_scheme, link["scheme"]).otherwise(base.scheme)
    text = (
        F.when(link["href"] == "", base.raw)
        .when(malformed_host(link["netloc"]), None)
        .when(other_scheme, link["href"])
        .otherwise(joined)
    )
    return F.struct(
        link["href"].alias("href"),
        F.when(scheme.startswith("http"), text).alias("link"),
        F.when(other_scheme, link["netloc"]).otherwise(netloc).alias("netloc"),
    )


def _prefixed(mark: str, part: Column) -> Column:
    return F.when(part == "", "").otherwise(F.concat(F.lit(mark), part))


def page_features(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Counts and flags that are read off the page text itself."""
    wide, base = staged(with_links(pages, url, html, keep_visible=True), url)
    wide = wide.withColumn("_host", base.host)
    popup = F.contains(html, F.lit(POPUP[0])) | F.contains(html, F.lit(POPUP[1]))
    external = F.filter(
        "links",
        lambda link: (link["netloc"] != "") & (F.lower(link["netloc"]) != F.col("_host")),
    )
    return wide.select(
        *pages.columns,
        F.size("links").alias("num_anchors"),
        F.size(external).alias("external_anchors"),
        _count("_visible", FORM).alias("num_forms"),
        F.when(popup, 1).otherwise(0).alias("has_popup"),
        _count("_visible", META_REFRESH).alias("meta_refresh"),
    )


def _count(text: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("int")


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
