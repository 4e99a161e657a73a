import math
import re
from collections import Counter

from porter_ref import stem as porter
from pyspark.sql import functions as F

from sqloracle.fixed import STOP_WORDS
from tidemark.operators import rank
from tidemark.operators.index import build_index
from tidemark.operators.reindex import recomputed_stats, reindex, stamp

PAGES = [
    (11, "https://trains.test/night", "Night trains of the north",
     "Night trains cross the mountains and the rivers. A sleeper train leaves every evening, and trains return by morning."),
    (12, "https://trains.test/steam", "Steam engines", "Steam engines pulled heavy trains over the mountains until diesel engines came."),
    (13, "https://kitchen.test/soup", "Onion soup", "Slice onions, brown onions slowly, pour stock. Soup wants patience, bread and cheese."),
    (14, "https://garden.test/onion", "Growing onions", "Onions grow in loose soil with sun. Water them in the evening."),
]


def corpus(spark, rows=PAGES):
    return spark.createDataFrame(
        [(i, u, "example.com", t, "", b) for i, u, t, b in rows],
        "doc_id long, url string, domain string, title string, snippet string, body string")


def search(spark, idx, q, **kw):
    qs = spark.createDataFrame([(0, q)], "query_id long, query string")
    return [(r.doc_id, r.score, r.total_hits) for r in rank.bm25_search(idx, qs, **kw).orderBy("rank").collect()]


def plain_words(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1 and w not in STOP_WORDS]


def plain_bm25(query, rows=PAGES):
    """The ranking function written out: k1 1.5, b 0.75, a title word counts four times."""
    docs = {i: (Counter(map(porter, plain_words(b))), Counter(map(porter, plain_words(t))), len(plain_words(b))) for i, _, t, b in rows}
    mean = sum(n for *_, n in docs.values()) / len(docs)
    scores = Counter()
    for term in set(map(porter, plain_words(query))):
        having = [i for i, (b, t, _) in docs.items() if b[term] + t[term]]
        idf = math.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
        for i in having:
            body, title, n = docs[i]
            tf = body[term] + 4 * title[term]
            scores[i] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    return [(i, round(x, 3), len(scores)) for i, x in sorted(scores.items(), key=lambda p: (-round(p[1], 9), p[0]))]


def test_index_shape(spark):
    idx = build_index(corpus(spark))
    assert {r.doc_id: r.body_length for r in idx.documents.collect()} == {11: 13, 12: 9, 13: 12, 14: 7}
    st = idx.stats.first()
    assert (st.doc_count, st.total_length, st.avg_length) == (4, 41, 10.25)
    p = {(r.term, r.doc_id): (r.tf_body, r.tf_title) for r in idx.postings.collect()}
    assert p[("train", 11)] == (3, 1) and p[("train", 12)] == (1, 0)
    assert p[("onion", 13)] == (2, 1) and p[("engin", 12)] == (2, 1)
    assert {r.term: r.df for r in idx.terms.collect()}["onion"] == 2


def test_scores_follow_the_formula(spark):
    idx = build_index(corpus(spark))
    for query in ("trains", "onion soup", "evening mountains engine", "soup soup SOUP", "Growing"):
        assert search(spark, idx, query) == plain_bm25(query)
    assert search(spark, idx, "of the an") == [] and search(spark, idx, "   ") == []
    assert [d for d, *_ in search(spark, idx, "onions", max_postings_per_term=1)] == [13]
    assert len(search(spark, idx, "evening", limit=0)) == 2


def test_ties_break_on_doc_id_and_limit(spark):
    rows = [(i, f"https://t.test/{i}", "", "same words here") for i in (7, 3, 5)]
    idx = build_index(corpus(spark, rows))
    got = search(spark, idx, "same words", limit=2)
    assert [d for d, _, _ in got] == [3, 5] and got[0][2] == 3


def test_response_shape(spark):
    idx = build_index(corpus(spark))
    qs = spark.createDataFrame([(0, "soup"), (1, "zzzz")], "query_id long, query string")
    res = rank.with_document_fields(rank.bm25_search(idx, qs), idx.documents)
    out = {r.query_id: r for r in rank.search_response(qs, res).collect()}
    assert out[0].totalHits == 1 and out[0].results[0].id == "idx-13" and out[0].results[0].source == "google"
    assert out[1].totalHits == 0 and out[1].results == []
    counts = rank.tab_counts(res).first()
    assert counts["all"] == 1 and counts["google"] == 1 and counts["movies"] == 0


def test_reindex_modes_and_invariants(spark):
    base = corpus(spark)
    old = build_index(base)
    old_ts = stamp(old.documents, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    changed = [
        (11, PAGES[0][1], "Another title", PAGES[0][3]),                  # same body -> unchanged, title stays
        (12, PAGES[1][1], PAGES[1][2], PAGES[1][3] + " Extra words."),   # updated
        (19, "https://trains.test/new", "New", "Fresh content here"),     # inserted
        (20, "https://trains.test/empty", "Empty", ""),                  # skipped
    ]
    batch = corpus(spark, changed)
    kept = batch.filter(F.length("body") > 0)
    skipped = batch.filter(F.length("body") == 0).select("url")
    r = reindex(old, old_ts, kept, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), skipped)
    modes = {x.url: (x.mode, x.length_delta) for x in r.modes.collect()}
    assert modes[PAGES[0][1]] == ("unchanged", 0)
    assert modes[PAGES[1][1]][0] == "updated" and modes[PAGES[1][1]][1] == 2
    assert modes["https://trains.test/new"] == ("inserted", 2)
    assert modes["https://trains.test/empty"] == ("skipped", 0)
    docs = {d.url: d for d in r.documents_ts.collect()}
    assert docs[PAGES[0][1]].title == PAGES[0][2]
    assert str(docs[PAGES[0][1]].updated_at) == "2024-01-01 00:00:00"
    assert str(docs[PAGES[1][1]].updated_at) == "2024-01-02 00:00:00"
    a, b = r.index.stats.first(), recomputed_stats(r.index).first()
    assert (a.doc_count, a.total_length) == (b.doc_count, b.total_length) == (5, 45)
    fresh = build_index(corpus(spark, [PAGES[0], changed[1], PAGES[2], PAGES[3], changed[2]]))
    assert sorted(map(tuple, r.index.postings.select("term", "doc_id", "tf_body", "tf_title").collect())) == \
        sorted(map(tuple, fresh.postings.select("term", "doc_id", "tf_body", "tf_title").collect()))


def test_reindex_same_batch_twice_is_unchanged(spark):
    old = build_index(corpus(spark))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    r = reindex(old, stamp(old.documents, ts), corpus(spark), ts)
    assert {x.mode for x in r.modes.collect()} == {"unchanged"}


def test_tab_filter_and_seed_list(spark, tmp_path):
    from tidemark.sources.tables import read_seed_list

    res = spark.createDataFrame([(0, 1, "youtube"), (0, 2, "google"), (0, 3, "youtube"), (0, 4, "archive")],
                                "query_id long, rank int, source string")
    yt = [r.rank for r in rank.tab_filter(res, "youtube", 1).collect()]
    assert yt == [1]
    mv = [(r.rank, r.tab_rank) for r in rank.tab_filter(res, "movies").collect()]
    assert mv == [(4, 1)]
    path = tmp_path / "seeds.json"
    path.write_text('[\n "https://a.test/",\n "https://b.test/x"\n]\n')
    seeds = [(r.pos, r.url) for r in read_seed_list(spark, str(path)).orderBy("pos").collect()]
    assert seeds == [(0, "https://a.test/"), (1, "https://b.test/x")]


def test_cap_off_equals_cap_at_least_n(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from tidemark.operators.index import index_documents_table

    idx = index_documents_table(docs)
    qs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    n = docs.count()
    a = rank.bm25_search(idx, qs, 20, None).collect()
    b = rank.bm25_search(idx, qs, 20, n).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 0


def test_delete_documents_reduces_postings_and_statistics(spark):
    from tidemark.operators.reindex import delete_documents

    left = delete_documents(build_index(corpus(spark)), spark.createDataFrame([(12,), (12,), (99,)], "doc_id long"))
    fresh = build_index(corpus(spark, [PAGES[0], PAGES[2], PAGES[3]]))
    cols = ["term", "doc_id", "tf_body", "tf_title"]
    assert sorted(map(tuple, left.postings.select(cols).collect())) == sorted(map(tuple, fresh.postings.select(cols).collect()))
    assert left.stats.first() == fresh.stats.first()
    assert sorted(map(tuple, left.terms.collect())) == sorted(map(tuple, fresh.terms.collect()))


def page(i, url, body, at=None):
    return (i, url, f"<body>{body}</body>", at)


def settled(spark, rows):
    from tidemark.plans.pages import extract_pages, settle_versions

    df = spark.createDataFrame(rows, "page_id long, url string, html string, arrived_at timestamp")
    return settle_versions(extract_pages(df))


def test_pages_that_arrive_twice_are_neither_lost_nor_doubled(spark):
    import datetime as dt

    one, two = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [page(7, "https://x.test/a", "old text", one), page(7, "https://x.test/a", "new text", two), page(7, "https://x.test/b", "same id"),
            page(8, "https://x.test/c", "twice"), page(8, "https://x.test/c", "twice"), page(1, "https://x.test/d", "late", two), page(9, "https://x.test/d", "early", one)]
    got = {r.url: r.body for r in settled(spark, rows).collect()}
    assert got == {"https://x.test/a": "new text", "https://x.test/b": "same id", "https://x.test/c": "twice", "https://x.test/d": "late"}
    idx = build_index(settled(spark, rows))
    assert idx.documents.select("doc_id").distinct().count() == 4
    assert {r.tf_body for r in idx.postings.filter("term = 'twice'").collect()} == {1}


def test_ids_stay_apart_when_urls_swap_pages(spark):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = build_index(settled(spark, [page(7, "https://x.test/a", "first page")]))
    r = reindex(old, stamp(old.documents, ts), settled(spark, [page(7, "https://x.test/b", "other page")]), ts)
    assert r.index.documents.select("doc_id").distinct().count() == 2
    assert {x.doc_id for x in r.index.postings.collect()} == {x.doc_id for x in r.index.documents.collect()}
    assert r.index.stats.first().doc_count == 2


def test_stored_index_answers_like_the_one_in_memory(spark, tmp_path):
    import pytest

    from tidemark.sources import index_store

    idx = build_index(corpus(spark))
    index_store.write_version(idx, str(tmp_path / "i"), 1)
    stored = index_store.read_latest(spark, str(tmp_path / "i"))[1]
    for query in ("trains mountains", "onion"):
        assert search(spark, stored, query) == search(spark, idx, query)
    qs = spark.createDataFrame([(0, "onion")], "query_id long, query string")
    shown = rank.with_document_fields(rank.bm25_search(stored, qs), stored)
    assert sorted(r.id for r in shown.collect()) == ["idx-13", "idx-14"]
    assert index_store.versions(spark, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        index_store.write_version(build_index(corpus(spark, [PAGES[0], PAGES[0]])), str(tmp_path / "j"), 1)
