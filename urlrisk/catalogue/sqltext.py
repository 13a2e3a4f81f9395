"""DuckDB building blocks of the SQL twins."""

from __future__ import annotations

from urlrisk.plans.forest import LEAF_UNITS, RANDOM_DEPTH, RANDOM_TREES, STEPS, random_split
from urlrisk.schema import FEATURES, LEXICAL_FEATURES, SEED

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_START = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"
HOST = r"^(([a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+\.[a-zA-Z]{2,}|(\p{Nd}{1,3}\.){3}\p{Nd}{1,3})$"
SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def split(rel: str, col: str = "url", prefix: str = "") -> str:
    """``rel`` with the parts of ``col`` as ``{prefix}scheme`` and so on."""
    clean = f"regexp_replace(regexp_replace({col}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    return rf"""
        SELECT * EXCLUDE (_c),
          lower(regexp_extract(_c, '{SCHEME}', 1)) AS {prefix}scheme,
          regexp_extract(_c, '{_START}//([^/?#]*)', 1) AS {prefix}netloc,
          regexp_replace(regexp_extract(_c, '{_START}(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS {prefix}path,
          regexp_extract(_c, '^[^?#]*\?([^#]*)', 1) AS {prefix}query,
          regexp_extract(_c, '^[^#]*#(.*)$', 1) AS {prefix}fragment
        FROM (SELECT *, {clean} AS _c FROM {rel}) s"""


def reason(url: str = "url", check_scheme: bool = True) -> str:
    """Over the columns of :func:`split`."""
    scheme = "WHEN scheme NOT IN ('http', 'https') THEN 'bad_scheme'" if check_scheme else ""
    return rf"""CASE WHEN {url} IS NULL OR {url} = '' THEN 'null_url' {scheme}
          WHEN netloc = '' THEN 'no_host'
          WHEN regexp_matches(netloc, '^\p{{Nd}}+$') THEN 'numeric_host'
          WHEN NOT regexp_matches(netloc, '{HOST}') THEN 'bad_host' END"""


_PARSABLE = (
    r"(coalesce(url <> '', false) AND (NOT regexp_matches(netloc, '[\[\]]')"
    r" OR regexp_matches(netloc, '^([^\[\]]*@)?\[[0-9a-fA-F:.]+\](:.*)?$')))"
)
STATUS = f"CASE WHEN {_PARSABLE} THEN 'ok' ELSE 'failed' END AS status"

_FEATURES = {
    "url_length": "length(url)",
    "has_ip": r"regexp_matches(lower(netloc), '^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$')",
    "https": "scheme = 'https'",
    "num_dots": "length(netloc) - length(replace(netloc, '.', ''))",
    "num_slashes": "length(url) - length(replace(url, '/', ''))",
    "has_at": "contains(url, '@')",
    "has_dash": "contains(netloc, '-')",
    "has_query": "query <> ''",
    "domain_length": "length(lower(netloc))",
    "tld_length": "CASE WHEN contains(netloc, '.') THEN length(split_part(netloc, '.', -1)) ELSE 0 END",
    "has_subdomain": "len(string_split(netloc, '.')) > 2",
}


def features(override: dict[str, str] | None = None) -> str:
    """The lexical features over the columns of :func:`split`."""
    texts = {**_FEATURES, **(override or {})}
    return ", ".join(
        f"CASE WHEN {_PARSABLE} THEN CAST({texts[name]} AS INT) END AS {name}" for name in LEXICAL_FEATURES
    )


DNS = (
    f"CASE WHEN {_PARSABLE} THEN CAST(coalesce((SELECT max(resolved) FROM dns_snapshot d"
    " WHERE d.host = lower(netloc)), 0) AS INT) END AS dns_record"
)

# --- labelled sources ---------------------------------------------------------
STRUCTURED = f"""
        SELECT 'structured' AS source, 1 AS src_priority, row_ord,
          nullif(replace(regexp_replace({strip("coalesce(protocol, 'http')")} || '://'
            || {strip("coalesce(domain_name, '')")} || '/' || {strip("coalesce(address, '')")},
            '//+', '/', 'g'), ':/', '://'), 'http://') AS url,
          CAST(CASE is_phished WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS INT) AS label
        FROM src_structured"""
FLAT = """
        SELECT 'flat' AS source, 2 AS src_priority, row_ord,
          CASE WHEN URL = '' OR starts_with(URL, 'http://') OR starts_with(URL, 'https://') THEN URL
            ELSE 'https://' || URL END AS url,
          CAST(CASE WHEN LABEL IN ('Good', 'good', 'Legitimate', 'legitimate') THEN 0
            WHEN LABEL IN ('Bad', 'bad', 'Phishing', 'phishing') THEN 1
            WHEN try_cast(LABEL AS DOUBLE) IN (0, 1) THEN try_cast(LABEL AS DOUBLE) END AS INT) AS label
        FROM src_flat"""
RANKED = f"""
        SELECT 'ranked' AS source, 3 AS src_priority, row_ord,
          CASE WHEN {strip("domain")} <> '' THEN 'https://' || {strip("domain")} END AS url,
          CAST(0 AS INT) AS label
        FROM src_ranked"""

SOURCE_VIEWS = "src_structured src_flat src_ranked"
ALL_ROWS = {"all_rows": f"{STRUCTURED} UNION ALL {FLAT} UNION ALL {RANKED}"}
AUDITED = {
    **ALL_ROWS,
    "audited": f"""SELECT source, src_priority, row_ord, url, label,
          coalesce({reason()}, CASE WHEN label IS NULL THEN 'bad_label' END) AS reason
        FROM ({split("all_rows")}) x""",
    "good": "SELECT source, src_priority, row_ord, url, label FROM audited WHERE reason IS NULL",
}
CLEAN = {
    **AUDITED,
    "clean": """SELECT * FROM good QUALIFY
          row_number() OVER (PARTITION BY url ORDER BY src_priority, row_ord) = 1""",
}
REJECTS = {
    **CLEAN,
    "rejected": """SELECT source, src_priority, row_ord, url, reason FROM audited WHERE reason IS NOT NULL
        UNION ALL SELECT source, src_priority, row_ord, url, 'duplicate' FROM good
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY src_priority, row_ord) > 1""",
}

# --- links --------------------------------------------------------------------
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[^>]*>|\z)|<style\b.*?(?:</style[^>]*>|\z)"
_HREF = (
    r"""(?i)<a[\s/](?:[^<>"'']*(?:"[^"]*"|''[^'']*''))*(?:[^<>"'']*\s)?href\s*=\s*"""
    r"""("[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)"""
)
HREFS = {
    "seen": rf"SELECT page_id, url, regexp_replace(html, '{_HIDDEN}', '', 'g') AS body, html FROM rich_pages",
    "raw_links": rf"""SELECT page_id, url, unnest(v) AS raw, generate_subscripts(v, 1) - 1 AS link_ord
        FROM (SELECT page_id, url, regexp_extract_all(body, '{_HREF}', 1) AS v FROM seen) s""",
    "hrefs": """SELECT page_id, url, CAST(link_ord AS INT) AS link_ord,
          replace(regexp_replace(raw, '^["'']|["'']$', '', 'g'), '&amp;', '&') AS href
        FROM raw_links""",
}
# The page paths hold no dot segments and the links at most one leading "..".
_FOLDER = "regexp_replace(b_path, '[^/]*$', '')"
_PARENT = f"regexp_replace({_FOLDER}, '[^/]+/$', '')"
LINKS = {
    **HREFS,
    "pairs": split(f"({split('hrefs', 'url', 'b_')})", "href", "l_"),
    "resolved": f"""SELECT page_id, link_ord, url, href, b_netloc, CASE
          WHEN l_scheme <> '' AND l_scheme <> b_scheme THEN href
          WHEN l_netloc <> '' THEN b_scheme || '://' || l_netloc || l_path || q || f
          ELSE b_scheme || '://' || b_netloc || CASE
            WHEN l_path = '' THEN b_path || CASE WHEN l_query = '' AND b_query <> '' THEN '?' || b_query ELSE q END
            WHEN starts_with(l_path, '/') THEN l_path || q
            WHEN starts_with(l_path, '../') THEN {_PARENT} || substr(l_path, 4) || q
            ELSE {_FOLDER} || l_path || q END || f END AS link
        FROM (SELECT *, CASE WHEN l_query <> '' THEN '?' || l_query ELSE '' END AS q,
          CASE WHEN l_fragment <> '' THEN '#' || l_fragment ELSE '' END AS f FROM pairs) x""",
    "links": """SELECT DISTINCT page_id, link FROM resolved
          WHERE regexp_matches(link, '^(?i)http[a-z0-9+.-]*:')""",
}
FRONTIER = {
    **LINKS,
    "firsts": r"""SELECT page_id AS seed_ord, link, regexp_extract(link, '^[^:]*://([^/?#]*)', 1) AS netloc
        FROM links QUALIFY row_number() OVER (
          PARTITION BY regexp_extract(link, '^[^:]*://([^/?#]*)', 1) ORDER BY page_id, link) = 1""",
}

# --- randomised trees -----------------------------------------------------------


def _leaf(tree: int, seed: int, node: int = 1) -> str:
    if node >> RANDOM_DEPTH:
        return str(node)
    name, step = random_split(tree, node, seed)
    split = f"({name} - min_{name}) * {STEPS} <= (max_{name} - min_{name}) * {step}"
    return f"CASE WHEN {split} THEN {_leaf(tree, seed, 2 * node)} ELSE {_leaf(tree, seed, 2 * node + 1)} END"


def _leaves(rel: str, seed: int, keep: str) -> str:
    """``keep`` of each row of ``rel`` with tree and leaf, a row per tree."""
    leaves = ", ".join(_leaf(tree, seed) for tree in range(RANDOM_TREES))
    return f"""SELECT {keep}, unnest([{leaves}]) AS leaf, unnest(range({RANDOM_TREES})) AS tree FROM {rel}, ranges"""


def forest(rows: str, training: str, key: str, seed: int = SEED, name: str = "") -> dict[str, str]:
    """CTE ``scored{name}``: ``key``, prediction and confidence of ``rows`` by trees counted over ``training``."""
    ends = ", ".join(f"min({f}) AS min_{f}, max({f}) AS max_{f}" for f in FEATURES)
    share = "ones / nullif(n1, 0)::DOUBLE"
    return {
        "ranges": f"SELECT {ends} FROM {training}",
        f"shares{name}": f"""SELECT tree, leaf, floor({LEAF_UNITS} * ({share}) / (zeros / nullif(n0, 0)::DOUBLE + {share})) AS units
          FROM (SELECT tree, leaf, count(*) FILTER (label = 0) AS zeros, count(*) FILTER (label = 1) AS ones
            FROM ({_leaves(training, seed, 'label')}) l GROUP BY 1, 2) c,
            (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM {training}) n""",
        f"scored{name}": f"""SELECT {key}, CAST(p > 0.5 AS INT) AS prediction, greatest(p, 1 - p) AS confidence
          FROM (SELECT {key}, sum(coalesce(units, {LEAF_UNITS // 2})) / {float(LEAF_UNITS * RANDOM_TREES)} AS p
            FROM ({_leaves(rows, seed, key)}) l LEFT JOIN shares{name} USING (tree, leaf) GROUP BY {key}) v""",
    }
