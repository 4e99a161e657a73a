"""One query string on a stored index: the same results, few rows read."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rank
from tidemark.operators.index import index_documents_table
from tidemark.sources import index_store

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lookup"))
    index_store.write_version(index_documents_table(spark.read.parquet(f"{SF_DIR}/documents.parquet")), root, 1, postings_per_bucket=1 << 20)
    return index_store.read_version(spark, root, 1)


def terms_of(spark, text):
    return rank.query_terms(spark.createDataFrame([(0, text)], "query_id int, query string"))


def scanned(df):
    """Rows that the scan of ``df``, a filtered table, hands on, and those that are left."""
    left = len(df.collect())
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), left


def searched(found):
    return [tuple(r) for r in found.orderBy("rank").collect()]


def middling(stored, n):
    """Terms that some hundred documents hold."""
    return [r.term for r in stored.terms.where("df between 100 and 300").orderBy("term").limit(n).collect()]


def test_three_terms_read_little_of_the_postings(spark, stored):
    text = " ".join(middling(stored, 3))
    asked = terms_of(spark, text)
    read, left = scanned(stored.narrowed(asked).postings.select("term", "doc_id"))
    assert left == stored.matches(asked).count() > 0
    assert read < 0.02 * stored.postings.count()


def test_a_term_that_does_not_occur_reads_nothing(spark, stored):
    """Between the smallest and the largest term of some row group, so only its Bloom filter can tell."""
    absent = [f"{t}zq" for t in middling(stored, 5)]
    for term in absent:
        one = spark.createDataFrame([(term,)], "term string")
        assert scanned(stored.narrowed(one).postings.select("term", "doc_id")) == (0, 0)


@pytest.mark.parametrize("text", ["water and light of the morning", "water", "  ", "", None, "the of", "zzzzqq", " ".join(["water", "light", "house", "river", "stone", "paper", "green", "white", "small", "great", "night", "world"])])
def test_one_query_equals_a_batch_of_one(spark, stored, text):
    batch = rank.bm25_search(stored, spark.createDataFrame([(0, text)], "query_id int, query string"), 20)
    assert searched(rank.search_one(stored, text, 20)) == searched(batch)


def test_one_query_on_an_index_that_is_not_stored(spark):
    index = index_documents_table(spark.createDataFrame([(1, "night trains"), (2, "onion soup"), (3, None)], "doc_id long, text string"))
    assert [r.doc_id for r in rank.search_one(index, "trains at night").collect()] == [1]
    assert rank.search_one(index, "", 5).count() == 0
    nothing = index_documents_table(spark.createDataFrame([], "doc_id long, text string"))
    assert rank.search_one(nothing, "trains").count() == 0
    assert index.narrowed(spark.range(0).select(F.lit("x").alias("term"))).postings.count() == 0
