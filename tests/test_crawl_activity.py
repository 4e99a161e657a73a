import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import enrich, frontier, history, robots



def as_of():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def t(h, m, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


def test_fetch_list_fixture(spark):
    ds = spark.createDataFrame([
        ("a.test", 3, t(11, 59, 50), 1000, False), ("b.test", 200, t(11, 0), 1000, False),
        ("c.test", 0, None, 1000, True), ("d.test", 1, t(11, 59, 59), 1000, False),
        ("e.test", 1, t(11, 59, 58), 5000, False)], schemas.DOMAIN_STATS)
    q = spark.createDataFrame([
        (1, "https://a.test/1", "a.test", 0, "pending", t(10, 2), None, None),
        (2, "https://a.test/2", "a.test", 0, "pending", t(10, 1), None, None),
        (3, "https://b.test/1", "b.test", 0, "pending", t(10, 0), None, None),
        (4, "https://c.test/1", "c.test", 0, "pending", t(10, 0), None, None),
        (5, "https://d.test/1", "d.test", 0, "pending", t(10, 0), None, None),
        (6, "https://e.test/1", "e.test", 0, "pending", t(10, 0), None, None),
        (7, "https://f.test/1", "f.test", 0, "pending", t(10, 3), None, None),
        (8, "https://a.test/0", "a.test", 0, "done", t(9, 0), None, None)], schemas.CRAWL_QUEUE)
    got = [r.id for r in frontier.fetch_list(q, ds, as_of(), max_pages=200).collect()]
    assert sorted(got) == [2, 7]
    assert [r.id for r in frontier.fetch_list(q, ds, as_of(), budget=1, max_pages=200).collect()] == [2]
    blocked = spark.createDataFrame([("a.test",)], "domain string")
    assert [r.id for r in frontier.fetch_list(q, ds, as_of(), max_pages=200, blocked=blocked).collect()] == [7]


def test_enqueue_and_fold(spark):
    q = spark.createDataFrame([(1, "https://a.test/x", "a.test", 0, "pending", t(10, 0), None, None)],
                              schemas.CRAWL_QUEUE)
    pages = spark.createDataFrame([("https://a.test/x", 0, ["/x", "/y", "/y#frag", "mailto:m@a.test", "https://B.test/z/"]),
                                   ("https://deep.test/", 4, ["/never"])],
                                  "url string, depth int, links array<string>")
    new = frontier.enqueue(frontier.discovered_links(pages, max_depth=4), q, as_of())
    assert sorted((r.url, r.depth) for r in new.collect()) == [("https://a.test/y", 1), ("https://b.test/z", 1)]
    ds = spark.createDataFrame([("a.test", 2, t(9, 0), 1000, False)], schemas.DOMAIN_STATS)
    outs = spark.createDataFrame([
        ("https://a.test/x", "a.test", "touch", t(12, 0, 1), 3000, None),
        ("https://a.test/x", "a.test", "done", t(12, 0, 2), None, None),
        ("https://n.test/", "n.test", "failed", t(12, 0, 3), None, "boom")], schemas.OUTCOME_LOG)
    q2, ds2 = frontier.fold_outcomes(q, ds, outs)
    assert q2.first().status == "done"
    d = {r.domain: r for r in ds2.collect()}
    assert (d["a.test"].pages_crawled, d["a.test"].crawl_delay_ms, d["a.test"].last_fetched_at) == (3, 3000, t(12, 0, 2))
    assert (d["n.test"].pages_crawled, d["n.test"].crawl_delay_ms) == (0, 1000)
    assert {r.status: r.n for r in frontier.queue_counts(q2).collect()} == {"done": 1}
    failed = spark.createDataFrame([(1, "https://a.test/x", "a.test", 0, "failed", t(10, 0), None, "boom")], schemas.CRAWL_QUEUE)
    assert frontier.fold_outcomes(failed, ds, outs)[0].first().error == "boom"  # only a new failure replaces the message
    flagged = frontier.block_domains(ds, spark.createDataFrame([("n.test",), ("a.test",)], "domain string"))
    assert {r.domain: r.disallowed for r in flagged.collect()} == {"a.test": True, "n.test": True}


def test_fetch_gate(spark):
    log = spark.createDataFrame([("u1", 200, "text/html", "<p>", None), ("u2", 200, "application/pdf", "x", None),
                                 ("u3", 404, "text/html", "", None), ("u4", 200, "text/html", "x" * 2_000_001, None)],
                                schemas.FETCH_LOG)
    got = {r.url: (r.outcome, r.error) for r in frontier.fetch_gate(log, max_bytes=2_000_000).collect()}
    assert got["u1"] == ("indexed", None) and got["u2"] == ("skipped-non-html", None)
    assert got["u3"][0] == "failed" and got["u4"][0] == "failed"


def test_bfs_min_depth(spark):
    seeds = spark.createDataFrame([("a",)], "url string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f")],
                                  "src_url string, url string")
    got = {r.url: r.depth for r in frontier.bfs_depths(seeds, edges, 4).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}


def test_robots_group_precedence(spark):
    open_text = "User-agent: gardener\nDisallow: /beds/\nAllow: /beds/roses\n\nUser-agent: *\nCrawl-delay: 4\nDisallow: /shed\n"
    rules = spark.createDataFrame([
        ("park.test", "User-agent: *\nDisallow: /\n", t(8, 0)), ("park.test", open_text, t(11, 0)),
        ("maze.test", "User-agent: *\nDisallow: /way\nAllow: /way/out\nDisallow: /way/out$\nAllow: /p*q$", t(11, 0)), ("void.test", "", t(11, 0))], schemas.ROBOTS_CACHE)
    probes = spark.createDataFrame([
        (1, "https://park.test/shed/tools", "park.test", "Gardener/3.1"), (2, "https://park.test/beds/tulips", "park.test", "Gardener/3.1"),
        (3, "https://park.test/beds/roses/red", "park.test", "Gardener/3.1"), (4, "https://park.test/shed/tools", "park.test", "Walker/2"),
        (5, "https://park.test/paths", "park.test", "Walker/2"), (6, "https://maze.test/way/out/now", "maze.test", "W"), (7, "https://maze.test/way/in", "maze.test", "W"),
        (8, "https://maze.test/way/out", "maze.test", "W"), (9, "https://maze.test/p/1/q", "maze.test", "W"), (10, "https://void.test/a", "void.test", "W"), (11, "https://lost.test/a", "lost.test", "W")],
        "probe_id long, url string, domain string, agent string")
    got = {r.probe_id: (r.allowed, r.crawl_delay_ms) for r in robots.check_permission(probes, rules).collect()}
    # the named group wins outright: no delay and no rule of "*" applies to it
    assert got[1] == (True, None) and got[2] == (False, None) and got[3] == (True, None)
    assert got[4] == (False, 4000) and got[5] == (True, 4000)  # the latest text of the domain, not the older "Disallow: /"
    assert [got[k][0] for k in (6, 7, 8, 9)] == [True, False, False, True]
    assert got[10] == (True, None) and got[11] == (True, None)
    fresh = spark.createDataFrame([("a.test", "", t(11, 0) - dt.timedelta(hours=23)),
                                   ("b.test", "", t(11, 0) - dt.timedelta(hours=25))], schemas.ROBOTS_CACHE)
    st = {r.domain: r.state for r in robots.cache_state(fresh, F.lit("2024-01-01 11:00:00").cast("timestamp")).collect()}
    assert st == {"a.test": "fresh", "b.test": "stale"}


def test_history_and_bookmarks(spark, tmp_path):
    h = spark.createDataFrame([("1", "u", "cats", t(10, 0)), ("2", "u", "dogs", t(10, 1)), ("3", "u", "Cats", t(10, 2)),
                               ("4", "u", "birds", t(10, 3)), ("5", "u", "cats", t(10, 4)), ("6", "v", "cats", t(9, 0))],
                              schemas.HISTORY)
    rec = [(r.rank, r.query) for r in history.recent_queries(h).filter("user_id = 'u'").orderBy("rank").collect()]
    assert rec == [(1, "cats"), (2, "birds"), (3, "Cats")]
    inp = spark.createDataFrame([("u", " CAT ")], "user_id string, input string")
    assert [r.query for r in history.suggestions(h, inp).orderBy("rank").collect()] == ["cats", "Cats"]
    marks = spark.createDataFrame([("u", "idx-1", "t", "https://x", t(9, 0))], schemas.BOOKMARKS)
    res = spark.createDataFrame([("u", "idx-1"), ("u", "idx-2"), ("v", "idx-1")], "user_id string, id string")
    flags = {(r.user_id, r.id): r.bookmarked for r in history.bookmark_flags(res, marks).collect()}
    assert flags == {("u", "idx-1"): True, ("u", "idx-2"): False, ("v", "idx-1"): False}
    assert history.delete_items(h, spark.createDataFrame([("1",)], "history_id string")).count() == 5
    path = str(tmp_path / "backup")
    users = spark.createDataFrame([("v",)], "user_id string")
    history.export_backup(h, path, users)
    back = history.read_backup(spark, path, schemas.HISTORY).withColumn("query", F.upper("query"))
    restored = history.restore(h, back, "v")
    assert sorted(r.query for r in restored.filter("user_id = 'v'").collect()) == ["CATS"]
    assert restored.filter("user_id = 'u'").count() == 5
    # rows exported under another user are re-keyed, and none is lost
    moved = history.restore(h, h.filter("user_id = 'u'"), "v")
    assert moved.filter("user_id = 'v'").count() == 5 and moved.count() == 10
    assert history.append(h, back).count() == 7


def test_dictionary_cards(spark):
    d = spark.createDataFrame([("hello", '[{"word":"hello","phonetics":[{"text":""},{"text":"/həˈləʊ/"}],'
                                         '"meanings":[{"partOfSpeech":"exclamation","definitions":[{"definition":"A greeting."}]}]}]'),
                               ("nope", '[{"word":"nope","meanings":[]}]')], "word string, entry_json string")
    q = spark.createDataFrame([(1, " Hello "), (2, "hello world"), (3, "nope"), (4, "h3llo")], "query_id long, query string")
    cards = enrich.cards_for_queries(q, d).collect()
    assert len(cards) == 1 and cards[0].query_id == 1 and cards[0].rank == 0
    assert cards[0].title == "hello (exclamation) - Definition & Meaning"
    assert cards[0].snippet == "Definition: A greeting. Pronunciation: /həˈləʊ/"
    assert cards[0].url.endswith("/english/hello") and cards[0].score == 100.0


def test_seed_queue_and_card_union(spark):
    q = spark.createDataFrame([(1, "https://a.test/x", "a.test", 0, "done", t(10, 0), None, None)], schemas.CRAWL_QUEUE)
    seeds = spark.createDataFrame([("https://A.test/x#top",), ("https://b.test/",), ("mailto:m@b.test",),
                                   ("https://b.test",)], "url string")
    got = sorted((r.url, r.depth, r.status) for r in frontier.seed_queue(seeds, q, as_of()).collect())
    assert got == [("https://b.test/", 0, "pending")]
    cards = spark.createDataFrame([(1, 0, "dict-a", "u", "a (n) - Definition & Meaning", "s", 100.0)],
                                  "query_id long, rank int, id string, url string, title string, snippet string, score double")
    res = spark.createDataFrame([(1, 1, "idx-3", "v", "t", "s", 1.5, "google")],
                                "query_id long, rank int, id string, url string, title string, snippet string, score double, source string")
    both = [r.id for r in enrich.with_cards(res, cards).orderBy("rank").collect()]
    assert both == ["dict-a", "idx-3"]
