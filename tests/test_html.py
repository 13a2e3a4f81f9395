"""Link extraction and resolution against the standard library."""

import itertools
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from urlrisk.functions import html
from urlrisk.operators import links

BASES = [
    "http://a.com", "https://a.com/", "http://a.com/b/c/d;p?q", "https://a.com/x/y/", "http://a.com/x//y?u#v",
    "http://a.com:80/x;1", "https://u@a.com/p?x=/y",
]
HREFS = [
    "", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..",
    "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
    "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "https:g", "http://b.com",
    "HTTPS://B.com/a/../b", "https://b.com/?", "//b.com/x/./y", "mailto:x@y.z", "javascript:void(0)", "ftp://b.com/x",
    " g", "g ", "g\th", "a//b", "/a//b", "//b.com", "x:y", "..;a", "g?", "g#", "a/b/../../../../c",
]


def test_resolution_equals_urljoin(spark):
    pages = [
        (i, base, f'<a href="{href}">x</a>')
        for i, (base, href) in enumerate(itertools.product(BASES, HREFS))
    ]
    df = spark.createDataFrame(pages, "page_id INT, url STRING, html STRING")
    got = {r.page_id: r.link for r in links.resolve_links(df).collect()}
    for i, (base, href) in enumerate(itertools.product(BASES, HREFS)):
        want = urljoin(base, href)
        want = want if urlparse(want).scheme.startswith("http") else None
        assert got.get(i) == want, (base, href)


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and "href" in values:
            self.found.append(values["href"])


def parser_hrefs(text):
    parser = Anchors()
    parser.feed(text)
    return parser.found


MARKUP = """
<A HREF="/upper">1</A><a href='/single'>2</a><a class=x href=/bare>3</a><a data-href="/no" href="/yes">4</a>
<a title="a > b" href="/quoted">5</a><a href="/x?a=1&amp;b=2&lt;&#65;&#x42;&eacute;&unknown;&">6</a>
<a
 href = "/newline"
>7</a><a name="none">8</a><abbr href="/abbr">9</abbr><area href="/area"><link href="/link">
<!-- <a href="/comment">c</a> --><script>"<a href='/script'>"</script><style>a{}<a href="/style"></style>
<a href="">10</a><a class="x"href="/tight">11</a><a/href="/slash">12</a><a id='i' href="it's">13</a>
<a href="/dup1" href="/dup2">14</a><p>text with "quotes" and it's > fine</p><a href="/last">15</a>
"""


def test_hrefs_equal_a_parser(spark):
    df = spark.createDataFrame([(MARKUP,)], "html STRING").select(html.hrefs("html"))
    assert df.first()[0] == parser_hrefs(MARKUP)


def test_any_number_of_attributes(spark):
    pages = [
        "<a " + 'x="1" ' * 10_000 + 'href="/far">f</a><a href=/near>n</a>',
        "<a " + "y " * 10_000 + "href='/bare'>f</a>",
        "<a " + "z=1 " * 10_000 + 'href="/first" href="/second">f</a>',
        "<a href=it's>1</a> <a href='b'>2</a><a x = 'href=\"/no\"' href=c>3</a><a title='href=d'>4</a>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id INT, html STRING").select("id", html.hrefs("html"))
    assert dict(df.collect()) == {
        0: ["/far", "/near"], 1: ["/bare"], 2: ["/second"], 3: ["it's", "b", "c"]
    } == {i: parser_hrefs(text) for i, text in enumerate(pages)}


def test_hrefs_of_stored_pages_equal_a_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in pages.select("html", html.hrefs("html").alias("hrefs")).collect():
        assert row.hrefs == parser_hrefs(row.html)


def test_null_and_hostile_pages(spark):
    pages = [
        (1, "http://a.com/", None),
        (2, "http://a.com/", "<a " + "x='y' " * 240 + "href=/far>"),
        (3, "http://a.com/", "<a " + '"' * 20001 + "<a href=/x"),
        (4, "http://a.com/", "<a href='http://[bad/'>x</a><a href='/ok'>y</a>"),
        (5, "http://a.com/", "<a " * 300_000),
        (6, "http://a.com/", "<script>" * 100_000 + "<a href=/in-script>"),
        (7, "http://a.com/", "<a x='" * 100_000),
        (8, "http://a.com/", "<meta " * 100_000),
    ]
    df = spark.createDataFrame(pages, "page_id INT, url STRING, html STRING")
    found = {}
    for row in links.distinct_links(df).collect():
        found.setdefault(row.page_id, []).append(row.link)
    assert found.get(1) is None
    assert html.page_features(df).filter("num_forms > 0").count() == 0
    assert found[2] == ["http://a.com/far"]
    assert found.get(6) is None
    assert found[4] == ["http://a.com/ok"]
    assert [r.url for r in links.failed_pages(df).collect()] == ["http://a.com/"]


def test_links_are_distinct_per_page(spark):
    text = '<a href="/x">1</a><a href="x">2</a><a href="http://a.com/x">3</a><a href="mailto:a">4</a>'
    df = spark.createDataFrame([(1, "http://a.com/", text), (2, "http://a.com/", text)], "page_id INT, url STRING, html STRING")
    assert sorted(tuple(r) for r in links.distinct_links(df).collect()) == [
        (1, "http://a.com/x"), (2, "http://a.com/x")
    ]


def test_page_features(spark):
    text = (
        '<form><FORM id=x></form><a href="/a">1</a><a href="http://B.com/">2</a><a href="http://A.com/z">3</a>'
        "<meta http-equiv=refresh content=1><META HTTP-EQUIV='Refresh'><!-- <form> -->"
        "<script>window.open('x')</script><formula>"
    )
    df = spark.createDataFrame([(1, "http://a.com/", text), (2, "http://a.com/", None)], "page_id INT, url STRING, html STRING")
    got = {r.page_id: r for r in html.page_features(df).collect()}
    assert (got[1].num_anchors, got[1].external_anchors, got[1].num_forms) == (3, 1, 2)
    assert (got[1].has_popup, got[1].meta_refresh) == (1, 2)
    assert (got[2].num_anchors, got[2].external_anchors, got[2].num_forms, got[2].has_popup) == (0, 0, 0, 0)


def test_no_shuffle_up_to_the_distinct_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = links.distinct_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_unescape_numeric_limits(spark):
    texts = ["&#0;", "&#xD800;", "&#x110000;", "&#x1F600;", "a&b&amp;c", "&amp", "&&amp;;"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(html.unescape(F.col("t")))
    assert [r[0] for r in df.collect()] == [
        "\ufffd", "\ufffd", "\ufffd", "\U0001f600", "a&b&c", "&amp", "&&;"
    ]


def test_numeric_references_follow_the_standard(spark):
    import html as standard

    codes = [0, 1, 8, 9, 10, 11, 12, 13, 14, 31, 32, 65, 126, 127, *range(0x80, 0xA1), 0xD7FF, 0xD800, 0xDFFF, 0xE000,
             0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 99999999999999999999]
    texts = [f"a{form}b" for c in codes for form in (f"&#{c};", f"&#x{c:x};", f"&#0000000{c};", f"&#X000000{c:X};")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", html.unescape(F.col("t")).alias("v")).collect()}
    assert got == {t: standard.unescape(t) for t in texts}
