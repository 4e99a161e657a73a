"""The segment store: a batch writes its own size, looks up by sketch and bucket, and reads like a rebuilt index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rank
from tidemark.operators.index import build_index, corpus_from_documents
from tidemark.sources.segments import SegmentStore

CORPUS = "doc_id long, url string, domain string, title string, snippet string, body string"


def corpus(spark, bodies):
    return spark.createDataFrame([(i, f"https://x.test/{i}", "x.test", f"title {i}", "", b) for i, b in bodies.items()], CORPUS)


def at(n):
    return F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def same_as_rebuilt(spark, store, bodies):
    index, whole = store.index(), build_index(corpus(spark, bodies))
    for columns in (("term", "doc_id", "tf_body", "tf_title", "doc_len"),):
        assert rows(index.postings, *columns) == rows(whole.postings, *columns)
    assert rows(index.terms, "term", "df") == rows(whole.terms, "term", "df")
    assert rows(index.stats, "doc_count", "total_length", "avg_length") == rows(whole.stats, "doc_count", "total_length", "avg_length")
    assert rows(index.documents, "doc_id", "url", "content_hash", "body_length") == rows(whole.documents, "doc_id", "url", "content_hash", "body_length")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "missing")], "query_id long, query string")
    columns = ["query_id", "rank", "doc_id", "score", "total_hits"]
    assert rows(rank.bm25_search(index, asked, 5), *columns) == rows(rank.bm25_search(whole, asked, 5), *columns)
    assert rows(rank.bm25_search(index, asked, 5, 3), *columns) == rows(rank.bm25_search(whole, asked, 5, 3), *columns)
    for text in ("alpha beta", "missing", ""):
        assert rows(rank.search_one(index, text, 5), *columns) == rows(rank.search_one(whole, text, 5), *columns)
    shown = [*columns[:3], "url", "title"]
    assert rows(rank.with_document_fields(rank.bm25_search(index, asked, 5), index), *shown) == \
        rows(rank.with_document_fields(rank.bm25_search(whole, asked, 5), whole.documents), *shown)


def test_batches_replacements_deletions_and_merges_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "words"]) for _ in range(rnd.randrange(1, 12)))
    store = SegmentStore(spark, str(tmp_path), fanin=2, docs_per_bucket=4, postings_per_bucket=8)
    state = {}
    for day in range(1, 5):
        batch = {i: text() for i in rnd.sample(range(40), 9)}
        batch |= {i: state[i] for i in list(state)[:2]}  # seen again, unchanged
        gone = rnd.sample(sorted(state), min(len(state), 3)) + [999]
        modes = {r.doc_id: (r.mode, r.length_delta) for r in store.apply(
            corpus(spark, batch), at(day), f"day {day}", gone=spark.createDataFrame([(g,) for g in gone + gone], "doc_id long")).collect()}
        want = {i: ("inserted" if i not in state else "unchanged" if state[i] == b else "updated") for i, b in batch.items() if i not in gone}
        assert {i: m for i, (m, _) in modes.items()} == want
        assert all(d == (0 if m == "unchanged" else len(batch[i].split()) - (len(state[i].split()) if m == "updated" else 0)) for i, (m, d) in modes.items())
        state = {i: b for i, b in (state | batch).items() if i not in gone}
    same_as_rebuilt(spark, store, state)
    assert len(store.segments()) < 4 and store.compact() == []
    buckets = {s.doc_buckets for s in store.segments()}
    assert max(buckets) > 1


def test_stamps_names_and_clashes(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path))
    store.apply(corpus(spark, {1: "a b", 2: "c"}), at(1), "one")
    before = store.segments()
    assert store.apply(corpus(spark, {1: "other", 3: "d"}), at(5), "one").count() == 0 and store.segments() == before
    store.apply(corpus(spark, {1: "a b", 2: "changed"}), at(2), "two")
    got = {r.doc_id: (r.crawled_at.day, r.updated_at.day) for r in store.index().documents.collect()}
    assert got == {1: (2, 1), 2: (2, 2)}
    with pytest.raises(ValueError):
        store.apply(spark.createDataFrame([(1, "https://y.test/", "y.test", "", "", "x y")], CORPUS), at(3), "clash")
    assert len(store._log()) == 2
    assert {r.doc_id: r.content_hash for r in store.index(0).documents.collect()}.keys() == {1, 2}


def test_empty_batches_and_an_empty_store(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path))
    assert store.index().postings.count() == 0 and store.index().stats.first().doc_count == 0
    store.apply(corpus(spark, {1: "a"}).limit(0), at(1), "nothing")
    assert store.index().documents.count() == 0
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert rank.bm25_search(store.index(), asked).count() == 0


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_one_percent_costs_less_than_three(spark, tmp_path):
    docs = corpus_from_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    docs = docs.filter(F.length("body") > 0)
    store = SegmentStore(spark, str(tmp_path), docs_per_bucket=500, postings_per_bucket=100_000)
    store.apply(docs, at(1), "all")
    base = size_of(tmp_path)
    few = docs.filter(F.pmod("doc_id", F.lit(100)) == 7)
    batch = few.withColumn("body", F.concat("body", F.lit(" revised")))
    new = batch.filter(F.pmod("doc_id", F.lit(1000)) == 7).withColumn("doc_id", -F.col("doc_id") - 1)
    modes = store.apply(batch.unionByName(new), at(2), "one percent")
    counts = {r["mode"]: r["count"] for r in modes.groupBy("mode").count().collect()}
    assert counts == {"updated": few.count(), "inserted": new.count()}
    assert size_of(tmp_path) - base < 0.03 * base
    # deletions write tombstones and differences only
    before = size_of(tmp_path)
    store.apply(docs.limit(0), at(3), "gone", gone=few.select("doc_id"))
    made = max(store.segments(), key=lambda s: s.segment)
    assert (made.n_docs, made.n_dead) == (0, few.count())
    assert size_of(tmp_path) - before < 0.01 * base
    assert store.index().documents.count() == docs.count() - few.count() + new.count()


def test_lookups_open_only_possible_buckets(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path), docs_per_bucket=64)
    store.apply(corpus(spark, {i: f"word{i}" for i in range(4000)}), at(1), "base")
    segments = store.segments()
    assert segments[0].doc_buckets == 64
    ids = lambda values: spark.createDataFrame([(v,) for v in values], "doc_id long")
    found, opened = store.lookup(ids(range(10)), segments)
    assert found.count() == 10 and 0 < len(opened[0]) <= 10
    found, opened = store.lookup(ids(range(1_000_000, 1_000_030)), segments)  # all new: about one false hit in a hundred
    assert found.count() == 0 and len(opened.get(0, [])) <= 3
    assert store.lookup(ids(range(4000)), segments)[0].count() == 4000
    # the stored side of a batch's lookup is scanned in place: its rows are in no exchange
    possible = store.possible(ids(range(10)), segments)
    stored = store.read(segments[0], "documents").where(F.col("doc_bucket").isin(opened.get(0, []) or [1]))
    from tidemark.operators.util import materialize

    plan = stored.join(materialize(possible).select("doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
