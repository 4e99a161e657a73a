"""The markup reader on pages as they come: long tags, nested and unclosed elements, references without a semicolon."""

import time

from pyspark.sql import functions as F

from tidemark.functions.html import add_page_fields, decode_entities

LONG_TAGS = {
    "unquoted value": "<body>a<a href=" + "x" * 3000 + ">b</a>c",
    "unquoted style": "<body>a<div style=" + "y" * 50_000 + ">b</div>c",
    "many attributes": "<body>a<div" + "".join(f' d{i}="{i}"' for i in range(20_000)) + ">b</div>c",
    "data url": "<body>a<img src=data:" + "A" * 200_000 + ">bc",
    "quoted quotes": "<body>a<p " + "x='\">' " * 20_000 + ">bc",
}


def read(spark, *pages, **options):
    df = spark.createDataFrame([(i, "https://p.test/", h) for i, h in enumerate(pages)], "i int, url string, html string")
    return add_page_fields(df, **options).orderBy("i").collect()


def body(spark, *pages):
    return [r.body_text for r in read(spark, *pages)]


def test_long_tags_neither_recurse_nor_lose_text(spark):
    rows = read(spark, *LONG_TAGS.values())
    assert [r.body_text for r in rows] == ["abc"] * len(LONG_TAGS)
    assert rows[0].links == ["x" * 3000]


def test_unclosed_tag_takes_the_rest(spark):
    assert body(spark, "<body>a<a " + "text " * 1000, "<body>a<a href='x>" + "y" * 5000, "a<!-- b", "a<b") == ["a", "a", "a", "a"]
    assert [r.links for r in read(spark, "<a href='/x", '<a href="/y">z', "<a href=/z")] == [[], ["/y"], []]


def test_pages_of_one_kind_of_markup(spark):
    big = 5_000_000
    pages = ["<p title='" + "x" * big + "'>one tag", "<i a" + " b" * (big // 2) + ">two", "<nav></nav>" * 50_000 + "three", "<div>" * 100_000 + "four",
             "<" * 50_000 + "five", "<nav>" * 50_000 + "</nav>" * 49_999 + "hidden</nav>six", "a<b>&amp;</b>" * 50_000]
    start = time.time()
    got = body(spark, *pages)
    assert got[:4] == ["one tag", "two", "three", "four"]
    assert got[4:] == ["<" * 49_999, "six", "a&" * 50_000]
    assert time.time() - start < 120


ELEMENTS = [
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("<header><header>a</header></header>b<header>c", "b"),
    ("<nav><footer>a</nav>b</footer>c", "bc"),
    ("<div><nav>a</div>b", "b"),
    ("<div><nav><div>a</div>b</div>c", "c"),
    ("<nav><div>a</nav>b</div>c", "bc"),
    ("<section><div><nav>a</section>b", "b"),
    ("</nav>a</div>b", "ab"),
    ("<form><form>in</form>tail</form>", "tail"),
    ("<button>a<button>b</button>c", "c"),
    ("<nav>a<form>b</nav>c", "c"),
    ("<svg/>a<svg><path/><svg></svg>b</svg>c", "ac"),
    ("<script>'</script>'</script>a", "'a"),
    ("<SCRIPT >if (a<b) '<nav>'</script x>a", "a"),
    ("<style>p{}</style>a<style>b", "a"),
    ("<iframe><p>x</iframe>a", "a"),
    ("<noscript><img></noscript>a", "a"),
    ("<nav-bar>a</nav-bar><navy>b", "ab"),
    ("<!doctype html><?php x ?></ bogus>a<!>b", "ab"),
    ("a<!-->b<!--->c<!-- - -- > --!>d<!---->e", "abcde"),
    ("a < b <3 c", "a < b <3 c"),
    ("<p title=don't>a</p><p title=\"x'>\">b</p>", "ab"),
    ("<textarea><nav>a</textarea>b", "<nav>ab"),
    ("<title>t</title>a</body></html>b", "ab"),
    ("", ""),
]


def test_elements_end_where_a_browser_ends_them(spark):
    got = body(spark, *[html for html, _ in ELEMENTS])
    assert [(h, g) for (h, _), g in zip(ELEMENTS, got, strict=True)] == ELEMENTS


def test_null_page(spark):
    row = spark.createDataFrame([("https://p.test/", None)], "url string, html string").transform(add_page_fields).first()
    assert (row.title, row.body_text, row.links) == ("https://p.test/", None, None)


REFERENCES = [
    ("&copy 2020", "© 2020", "© 2020"),
    ("&ampx", "&x", "&ampx"),
    ("&notit;", "¬it;", "&notit;"),
    ("&notin;&notin", "∉¬in", "∉&notin"),
    ("&copy=1&copy", "©=1©", "&copy=1©"),
    ("&#233x&#xE9;&#xe9z", "éxéé" + "z", "éxéé" + "z"),
    ("&#0;&#99999999999;&#x110000;&#xD800;", "�" * 4, "�" * 4),
    ("&#000000000065;&#128;", "A€", "A€"),
    ("&;&#;&#x;& &nosuch;", "&;&#;&#x;& &nosuch;", "&;&#;&#x;& &nosuch;"),
    ("&NewLine;&amp;lt;", "\n&lt;", "\n&lt;"),
    ("&lt&gt&LT", "<><", "<><"),
]


def test_references(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REFERENCES)], "i int, t string")
    got = df.select("i", "t", decode_entities(F.col("t")).alias("a"), decode_entities(F.col("t"), attribute=True).alias("b")).orderBy("i").collect()
    assert [(r.t, r.a, r.b) for r in got] == REFERENCES


def test_attributes_and_metas(spark):
    pages = ["<a HREF=1 href=2>x</a><a data-href=3>y</a><a x='href=4' / href = '5'>z</a><a href>n</a><abbr href=6>m</abbr><a\thref=\"&copy=7&lt\">o",
             "<meta name=description content=''><meta name=description content=second><meta property='og:description' content='og'>b",
             "<meta content='say \"a\" > b' name='description'>b", "<meta name=Description content=x><nav><meta name=description content=gone></nav>b"]
    rows = read(spark, *pages)
    assert rows[0].links == ["1", "5", "&copy=7<"]
    assert [r.snippet for r in rows[1:]] == ["og", 'say "a" > b', "b"]
    heads = read(spark, "<title> </title><h1>A <i>b</i> &amp; c</h1>d", "<nav><title>no</title></nav><h1>open<p>x", "<title>1</title><title>2</title>", "<h1>a</h2>b")
    assert [r.title for r in heads] == ["A b & c", "openx", "1", "a"]
