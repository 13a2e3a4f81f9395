"""Input views of the queries, built from the given tables.

The given tables hold clean, unique URLs. Each view covers a whole table and
turns it into the dirt, overlaps and skew the operators are made for, by rules
on hashes of the URL. The same text runs in Spark SQL and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "labels", "events")

VIEWS = {
    # Every page with its URL parts, two hash digits and a label.
    "base": """
        SELECT p.page_id, p.url, p.html,
          regexp_extract(p.url, '^([a-z]+):', 1) AS scheme,
          regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1) AS host,
          regexp_extract(p.url, '^[a-z]+://[^/?#]*/(.*)$', 1) AS rest,
          substr(md5('a|' || p.url), 1, 1) AS d1,
          substr(md5('b|' || p.url), 1, 1) AS d2,
          CAST(coalesce(l.toxic, CASE WHEN substr(md5('lbl|' || p.url), 1, 1) IN ('0', '1', '2', '3')
            THEN 1 ELSE 0 END) AS INT) AS lbl,
          l.doc_id IS NOT NULL AS in_labels
        FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id""",
    # All kinds of broken and unusual URLs.
    "dirty_urls": """
        SELECT page_id, CASE d1
          WHEN '0' THEN NULL
          WHEN '1' THEN host || '/' || rest
          WHEN '2' THEN upper(scheme) || '://' || host || '/' || rest
          WHEN '3' THEN scheme || '://' || host || ':8080/' || rest
          WHEN '4' THEN scheme || '://user:pw@' || host || '/' || rest
          WHEN '5' THEN scheme || '://10.0.0.' || CAST(page_id AS STRING) || '/' || rest
          WHEN '6' THEN 'ftp://' || host || '/' || rest
          WHEN '7' THEN scheme || '://' || chr(39) || host || '/' || rest
          WHEN '8' THEN scheme || '://12345/' || rest
          WHEN '9' THEN '  ' || url || ' '
          WHEN 'a' THEN scheme || '://[abc/' || rest
          WHEN 'b' THEN scheme || '://' || host || '.xn--p1ai/' || rest
          WHEN 'c' THEN scheme || '://' || chr(9) || host || '/' || rest || ';v=1'
          ELSE url END AS url
        FROM base""",
    # Null protocol and domain, quoted host, double slash, unknown label.
    "src_structured": """
        SELECT page_id AS row_ord,
          CASE WHEN d1 = '0' THEN NULL ELSE scheme END AS protocol,
          CASE d2 WHEN '0' THEN NULL WHEN '1' THEN chr(39) || host ELSE ' ' || host END AS domain_name,
          CASE WHEN d1 = '3' THEN '/' || rest ELSE rest END AS address,
          CASE WHEN d2 = '5' THEN 'maybe' WHEN lbl = 1 THEN 'yes' ELSE 'no' END AS is_phished
        FROM base""",
    # Missing schemes, quoted hosts, unknown and null labels; every page once
    # more with some labels flipped; one URL with a third of all rows.
    "src_flat": """
        SELECT page_id * 2 AS row_ord,
          CASE WHEN d1 = '2' THEN chr(39) || host || '/' || rest
               WHEN d1 IN ('4', '5', '6', '7') THEN host || '/' || rest ELSE url END AS URL,
          CASE WHEN d2 = '6' THEN 'GOOD' WHEN d2 = '7' THEN NULL
               WHEN lbl = 1 THEN CASE page_id % 4
                 WHEN 0 THEN 'Bad' WHEN 1 THEN 'bad' WHEN 2 THEN 'Phishing' ELSE '1' END
               ELSE CASE page_id % 4
                 WHEN 0 THEN 'Good' WHEN 1 THEN 'good' WHEN 2 THEN 'legitimate' ELSE '0.0' END
          END AS LABEL
        FROM base
        UNION ALL
        SELECT page_id * 2 + 1, url,
          CASE WHEN (lbl = 1) = (d1 IN ('8', '9')) THEN '0' ELSE '1' END
        FROM base
        UNION ALL
        SELECT page_id + 1000000000, (SELECT min(url) FROM pages), 'bad' FROM base""",
    # One row per host: punycode ending, blank, null, numeric, padded.
    "src_ranked": """
        SELECT min(page_id) AS row_ord, CASE substr(md5('rank|' || host), 1, 1)
          WHEN '0' THEN host || '.xn--fiqs8s' WHEN '1' THEN ' ' WHEN '2' THEN NULL
          WHEN '3' THEN '12345' WHEN '4' THEN '  ' || host || ' ' ELSE host END AS domain
        FROM base GROUP BY host""",
    # Hosts that were looked up: some do not resolve, others have no row.
    "dns_snapshot": """
        SELECT DISTINCT host, CASE WHEN substr(md5('dns|' || host), 1, 1) IN ('0', '1')
          THEN 0 ELSE 1 END AS resolved
        FROM base WHERE in_labels""",
    "registration_snapshot": """
        SELECT DISTINCT host, make_date(CAST(2000 + instr('0123456789abcdef',
          substr(md5('reg|' || host), 1, 1)) AS INT), 1, 1) AS created
        FROM base WHERE scheme = 'http'""",
    # Feature columns that came with a source, for some URLs, with gaps.
    "precomputed": """
        SELECT url, CAST(length(url) + 1 AS INT) AS long_url, 1 AS having_at,
          CASE WHEN instr(host, '-') > 0 THEN 1 ELSE 0 END AS has_dash_in,
          CASE WHEN d2 = '3' THEN NULL ELSE 1 END AS sub_domains
        FROM base WHERE in_labels""",
    "visited": "SELECT DISTINCT host AS netloc FROM base WHERE lbl = 1",
    # Pages with more kinds of links and markup; some were not fetched.
    "rich_pages": """
        SELECT page_id, url, CASE WHEN d1 = 'f' THEN NULL ELSE html || CASE d2
          WHEN '0' THEN '<form action="/x"><input></form>'
          WHEN '1' THEN '<META HTTP-EQUIV="refresh" content="5; url=/y">'
          WHEN '2' THEN '<A CLASS="x" HREF="' || scheme || '://ext.example.net/a?b=1&amp;c=2">e</A>'
          WHEN '3' THEN '<a class=x href=sub/page.html>r</a>'
          WHEN '4' THEN '<a href="//cdn.example.org/lib">c</a>'
          WHEN '5' THEN '<a href="../up">u</a><a href="../up">u</a>'
          WHEN '6' THEN '<a href="?q=1">q</a>'
          WHEN '7' THEN '<a href="#frag">f</a>'
          WHEN '8' THEN '<a href="mailto:x@example.com">m</a>'
          WHEN '9' THEN '<!-- <a href="/hidden">h</a> --><script>var s = "<a href=/js>";</script>'
          WHEN 'a' THEN '<a href="#" onclick="window.open(1)">p</a>'
          WHEN 'b' THEN '<a href="ftp://ftp.example.net/f">f</a>'
          WHEN 'c' THEN '<a ' || repeat('data-x="1" ', 400) || 'href="/far">f</a>'
          ELSE '' END END AS html
        FROM base""",
    # One request per event. A few URLs get most of them, the top one a third.
    "requests": """
        SELECT e.event_id, e.user_id, e.ts, p.url
        FROM (SELECT event_id, user_id, ts, CAST(floor(n * (u * u * u * u * u * u)) AS BIGINT) AS page_id
          FROM (SELECT event_id, user_id, ts, (SELECT count(*) FROM pages) AS n,
            CAST(event_id * 7919 % 10007 AS DOUBLE) / 10007e0 AS u FROM events) d) e
        JOIN pages p ON p.page_id = e.page_id""",
    "requests_json": """
        SELECT page_id, CASE WHEN d1 IN ('0', '1', '2', '3', '4') THEN '{"url":" ' || url || ' "}'
          WHEN d1 IN ('5', '6') THEN '{"other":1}'
          ELSE '{"urls":["' || url || '"," ' || url || '/x"]}' END AS body
        FROM base""",
    # Model output in steps of 1/256; null where a URL failed.
    "raw_scores": """
        SELECT url, CASE WHEN d1 <> '0' THEN CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END END AS prediction,
          CASE WHEN d1 <> '0' THEN CASE WHEN p > 0.5e0 THEN p ELSE 1e0 - p END END AS confidence
        FROM (SELECT url, d1, CAST(16 * instr('0123456789abcdef', d1)
          + instr('0123456789abcdef', d2) - 17 AS DOUBLE) / 256e0 AS p FROM base) s""",
    "eval_pairs": "SELECT toxic AS label, 1 - quality AS prediction FROM labels",
    "url_lines": """
        SELECT CASE WHEN d1 IN ('0', '1') THEN '   ' WHEN d1 = '2' THEN chr(9) || url || '  '
          ELSE url END AS value FROM base""",
}

# HTTP answers of found links; a link that never answered has no row.
STATUS_SQL = """
        SELECT link AS url, CASE substr(md5('st|' || link), 1, 1)
          WHEN '0' THEN 404 WHEN '1' THEN 503 WHEN '2' THEN 301 WHEN '3' THEN 400 ELSE 200 END AS status
        FROM (SELECT DISTINCT link FROM links) l WHERE substr(md5('st|' || link), 1, 1) <> 'f'"""

_ONLY_TABLES = {"requests", "eval_pairs"}


def _with(names: list[str]) -> list[str]:
    """The CTEs of the named views, ``base`` first where one needs it."""
    wanted = [name for name in VIEWS if name in names]
    if any(name not in _ONLY_TABLES for name in wanted) and "base" not in wanted:
        wanted.insert(0, "base")
    return [f"{name} AS ({VIEWS[name]})" for name in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views = _with([name])
    tables = [
        f"{table} AS (SELECT * FROM parquet.`{sf_dir}/{table}.parquet`)"
        for table in TABLES
        if re.search(rf"\b{table}\b", " ".join(views))
    ]
    return spark.sql(f"WITH {', '.join(tables + views)} SELECT * FROM {name}")


def oracle(names: str, body: str, ctes: dict[str, str] | None = None, recursive: bool = False) -> str:
    """DuckDB text: the named views, further CTEs in order, the final SELECT."""
    parts = _with(names.split()) + [f"{name} AS ({sql})" for name, sql in (ctes or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
