"""One pass of term counts without a shuffle, search by blocks of documents and of queries."""

from porter_ref import stem as porter
from pyspark.sql import functions as F
from test_rank_reindex import PAGES, corpus, plain_bm25

from tidemark.functions.stem import add_stem, stem_word
from tidemark.functions.text import index_words
from tidemark.operators import rank
from tidemark.operators.index import build_index
from tidemark.operators.util import materialize


def test_one_word_is_stemmed_as_in_spark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(w,) for w in "y yy ied sing feed agreed hopping falling sky ion lion tion session 12s 3ing yes rolll e eee".split()], "word string")
    words = docs.select(F.explode(index_words(F.col("text"))).alias("word")).unionByName(odd).distinct()
    rows = add_stem(words, "word", "term").collect()
    assert len(rows) > 1000
    assert [(r.word, r.term) for r in rows if not r.term == stem_word(r.word) == porter(r.word)] == []


def test_postings_of_single_ids_are_not_shuffled(spark):
    index = build_index(corpus(spark))
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_added_up(spark):
    rows = [(1, "u", "Trains", "train of trains and rivers"), (1, "u", "", "train"), (None, "v", "", "rivers"), (None, "w", "River", "running"), (2, "x", "Kelvin", "été RIVERS")]
    index = build_index(corpus(spark, rows))
    got = {(r.term, r.doc_id): (r.tf_body, r.tf_title, r.doc_len) for r in index.postings.collect()}
    assert got == {("train", 1): (3, 1, 3), ("river", 1): (1, 0, 3), ("river", None): (1, 1, 1), ("run", None): (1, 0, 1),
                   ("kelvin", 2): (0, 1, 1), ("river", 2): (1, 0, 1)}
    assert {r.term: r.df for r in index.terms.collect()} == {"train": 1, "river": 3, "run": 1, "kelvin": 1}


def test_blocks_of_documents_and_queries_change_nothing(spark):
    index, texts = build_index(corpus(spark)), ["trains", "onion soup", "evening mountains engine", "the", "onions evening trains"]
    qterms = materialize(rank.query_terms(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")))
    asked = materialize(qterms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    scored = materialize(rank.scored_postings(index, asked))
    numbered = qterms.join(asked, "term").select("query_id", "number")
    for block_postings, block_query_terms in ((1 << 20, 1 << 20), (3, 1 << 20), (3, 2)):
        found = rank.top_k(rank.best_of_blocks(scored, numbered, 2, block_postings, block_query_terms), 2)
        for i, text in enumerate(texts):
            rows = found.filter(F.col("query_id") == i).orderBy("rank").collect()
            assert [(r.doc_id, round(r.score, 3), r.total_hits) for r in rows] == plain_bm25(text, PAGES)[:2], text


def test_hits_of_many_queries_stay_in_their_block(spark):
    """200 queries meet 500 documents in 100,000 pairs; at most blocks x limit rows a query leave."""
    index = build_index(corpus(spark, [(i, f"https://a.test/{i}", "", f"common word{i % 7}") for i in range(500)]))
    qterms = materialize(rank.query_terms(spark.createDataFrame([(i, "common") for i in range(200)], "query_id long, query string")))
    asked = materialize(qterms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    scored = materialize(rank.scored_postings(index, asked))
    assert scored.count() == 500  # each posting once, whatever the number of queries
    first = rank.best_of_blocks(scored, qterms.join(asked, "term").select("query_id", "number"), 3, block_postings=250)
    assert first.count() <= 2 * 3 * 200
    rows = rank.top_k(first, 3).collect()
    assert {r.total_hits for r in rows} == {500} and {(r.rank, r.doc_id) for r in rows} == {(1, 0), (2, 1), (3, 2)}
