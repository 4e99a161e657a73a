import duckdb
from pyspark.sql import functions as F

import porter_ref
from sqloracle.text import stem_ctes
from tidemark.functions.stem import add_stem
from tidemark.functions.text import STOP_WORDS, collapse_ws, index_words, query_words, snippet_cut, words


def test_stop_list_has_108_words():
    assert len(STOP_WORDS) == 108 and len(set(STOP_WORDS)) == 108


def test_python_reference_on_paper_pairs():
    for w, e in porter_ref.PAPER_PAIRS:
        assert porter_ref.stem(w) == e, w


def test_spark_stemmer_on_paper_pairs(spark):
    df = spark.createDataFrame(porter_ref.PAPER_PAIRS, "word string, expected string")
    bad = [r for r in add_stem(df, "word", "term").collect() if r.term != r.expected]
    assert bad == []


def test_sql_stemmer_on_paper_pairs():
    con = duckdb.connect()
    values = ", ".join(f"('{w}')" for w, _ in porter_ref.PAPER_PAIRS)
    rows = dict(con.execute(f"WITH v(word) AS (VALUES {values}), {stem_ctes('v', 'st')} SELECT word, term FROM st").fetchall())
    assert {w: rows[w] for w, _ in porter_ref.PAPER_PAIRS} == dict(porter_ref.PAPER_PAIRS)


def test_spark_stemmer_matches_reference_on_corpus_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = docs.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    extra = spark.createDataFrame([(w,) for w in ["yes", "yelling", "syzygy", "ab", "a", "y", "sses", "ies", "eed",
                                                  "ing", "hopping", "12s", "99ing", "yyy"]], "word string")
    got = add_stem(vocab.unionByName(extra), "word", "term").collect()
    assert len(got) > 1000
    bad = [(r.word, r.term, porter_ref.stem(r.word)) for r in got if r.term != porter_ref.stem(r.word)]
    assert bad == []


def test_tokenizer_and_query_fallback(spark):
    df = spark.createDataFrame([("The Café, 2 cats & a DOG!",), ("the a an",), ("",), (None,)], "t string")
    r = df.select(words("t").alias("w"), index_words(F.col("t")).alias("k"), query_words(F.col("t")).alias("q")).collect()
    assert r[0].w == ["the", "caf", "2", "cats", "a", "dog"]
    assert r[0].k == ["caf", "cats", "dog"]
    assert r[1].k == [] and r[1].q == ["the", "a", "an"]
    assert r[2].w == [] and r[3].w == []


def test_whitespace_and_snippet(spark):
    body200, body201 = "x" * 200, "y" * 201
    df = spark.createDataFrame([(" a \n b\t c ", body200, body201)], "a string, b string, c string")
    r = df.select(collapse_ws(F.col("a")).alias("a"), snippet_cut(F.col("b")).alias("b"),
                  snippet_cut(F.col("c")).alias("c")).first()
    assert r.a == "a b c"
    assert r.b == body200 and r.c == "y" * 200 + "..."
