from pyspark.sql import functions as F

from tidemark.functions.html import add_page_fields
from tidemark.functions.urls import add_normalized_url, classify_source, display_url, get_domain

URL_CASES = [
    ("deep/er", "http://HOST.test/dir/", "http://host.test/dir/deep/er"),
    ("http://host.test/q?gclid=1&fbclid=2&k", None, "http://host.test/q?k="),
    ("HTTP://host.test:80/q/#frag", None, "http://host.test/q"),
    ("tel:+123", "http://host.test/", None),
    ("ftp://host.test/file", None, None),
    ("?b=1&a=2&b=0", "http://host.test/q?old=1", "http://host.test/q?a=2&b=1&b=0"),
    ("https://site.test/p?page=2&ref=x", None, "https://site.test/p?page=2"),
    ("https://site.test/p?utm_source=a&gclid=b", None, "https://site.test/p"),
    ("https://site.test/p//", None, "https://site.test/p/"),
    ("https://site.test/", None, "https://site.test/"),
    ("../x", "https://site.test/a/b/c", "https://site.test/a/x"),
    ("./x", "https://site.test/a/b/c", "https://site.test/a/b/x"),
    ("//other.test/x", "https://site.test/a", "https://other.test/x"),
    ("?q=1", "https://site.test/a?b=2#f", "https://site.test/a?q=1"),
    ("#top", "https://site.test/a?b=2#f", "https://site.test/a?b=2"),
    ("https://site.test/p?UTM_SOURCE=x", None, "https://site.test/p?UTM_SOURCE=x"),
    ("http://site.test:80/p", None, "http://site.test/p"),
    ("https://site.test:8443/p", None, "https://site.test:8443/p"),
    ("/für", "http://a.test/x", "http://a.test/f%C3%BCr"),
    ("https://s.test/p?q=a b&y=a+b&z=~*", None, "https://s.test/p?q=a+b&y=a+b&z=%7E*"),
    ("https://s.test/a/../../b/./c/..", None, "https://s.test/b"),
    ("https://s.test:99999/", None, None),
]


def test_normalize_url_cases(spark):
    df = spark.createDataFrame(URL_CASES, "href string, base string, expected string")
    got = add_normalized_url(df, "href", "base", "got").collect()
    bad = [(r.href, r.got, r.expected) for r in got if r.got != r.expected]
    assert bad == []


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(h, b) for h, b, _ in URL_CASES], "href string, base string")
    once = add_normalized_url(df, "href", "base", "u1")
    twice = add_normalized_url(once, "u1", None, "u2").filter(F.col("u1").isNotNull())
    rows = twice.collect()
    # one trailing slash is removed per application, so only a doubled slash changes again
    assert all(r.u1 == r.u2 for r in rows if not r.href.endswith("//"))
    assert [r.u2 for r in rows if r.href.endswith("//")] == ["https://site.test/p"]


def test_domain_and_source(spark):
    urls = ["https://Example.com/x", "https://en.wikipedia.org/wiki/A", "https://www.youtube.com/w", "https://youtu.be/x",
            "https://instagram.com/a", "https://archive.org/d", "https://other.test/", "not a url",
            "https://notwikipedia.org/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    r = df.select(get_domain(F.col("u")).alias("d"), classify_source(F.col("u")).alias("s")).collect()
    assert r[0].d == "example.com"
    assert [x.s for x in r] == ["google", "wikipedia", "youtube", "youtube", "instagram", "archive", "google", "google",
                                "wikipedia"]
    long = "https://x.test/" + "a" * 80
    assert df.sparkSession.createDataFrame([(long,)], "u string").select(display_url(F.col("u"))).first()[0] == long[:70] + "..."


def _page(spark, html, url="https://p.test/x"):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return add_page_fields(df).first()


def test_title_fallbacks(spark):
    assert _page(spark, "<html><head><title> T  one </title></head><body><h1>H</h1>b</body></html>").title == "T  one"
    assert _page(spark, "<html><head></head><body><h1> Only <b>h1</b> </h1>b</body></html>").title == "Only h1"
    assert _page(spark, "<html><body>b</body></html>").title == "https://p.test/x"


def test_snippet_sources(spark):
    both = '<head><meta content="Og" property="og:description"><meta name="description" content="D &amp; E"></head><body>b</body>'
    assert _page(spark, both).snippet == "D & E"
    assert _page(spark, '<head><meta property="og:description" content="Og"></head><body>b</body>').snippet == "Og"
    assert _page(spark, '<head><meta name="description" content=""></head><body>body</body>').snippet == "body"
    long = "<body>" + "w" * 201 + "</body>"
    assert _page(spark, long).snippet == "w" * 200 + "..."


def test_body_text_rules(spark):
    html = ('<html><head><script>var t="</p>";</script><style>p{}</style></head><body><nav><a href="/n">nav</a></nav>'
            '<!-- hidden --><p>a</p><p>b</p> x &amp; y &middot; &copy; &quot;q&quot;'
            '<header>h</header><form><button>go</button></form><footer>f</footer><a href="">e</a><a href="/k">k</a>')
    r = _page(spark, html)
    assert r.body_text == 'ab x & y · © "q"ek'
    assert r.links == ["/k"]


def test_links_are_uncut_unless_a_limit_is_given(spark):
    html = "<body>" + "".join(f'<a href="/l{i}">x</a>' for i in range(40)) + "<nav><a href='/in-nav'>n</a></nav></body>"
    df = spark.createDataFrame([("https://p.test/", html)], "url string, html string")
    assert len(add_page_fields(df).first().links) == 40
    assert add_page_fields(df, max_links=25).first().links[-1] == "/l24"
    assert add_page_fields(df, links_before_removal=True).first().links[-1] == "/in-nav"


def test_hard_markup(spark):
    assert _page(spark, "<p>caf&#233; &#8217;s &eacute; &mdash; &amp;lt; &#146; &#x1F600; &nosuch; &#0;</p>").body_text == "café ’s é — &lt; ’ 😀 &nosuch; �"
    bare = _page(spark, "<!DOCTYPE html><title>My Title</title><p>hello</p>")
    assert (bare.title, bare.body_text) == ("My Title", "hello")
    assert _page(spark, '<body><p title="a > b">text</p></body>').body_text == "text"
    assert _page(spark, "<body><nav-bar>kept</nav-bar> <nav>gone</nav> tail</body>").body_text == "kept tail"
    assert _page(spark, '<meta name="description" content="a > b &amp; c"><body>x</body>').snippet == "a > b & c"
    links = ('<a data-href="/no" href="/yes?a=1&amp;b=2">x</a><a\nhref=/bare>y</a><!-- <a href="/c">z</a> -->'
             "<script>var a=\"<a href='/s'>\"</script><nav><a title=\"q>r\" href='/n'>n</a></nav>")
    df = spark.createDataFrame([("https://p.test/", links)], "url string, html string")
    assert add_page_fields(df, links_before_removal=True).first().links == ["/yes?a=1&b=2", "/bare", "/n"]
    assert add_page_fields(df).first().links == ["/yes?a=1&b=2", "/bare"]
