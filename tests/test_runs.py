"""One Arrow pass gives documents and runs of postings; searches and writers meet the runs."""

import pytest
from pyspark.sql import functions as F
from test_rank_reindex import corpus

from tidemark.functions.text import index_words
from tidemark.operators import index as ix
from tidemark.sources import index_store
from tidemark.sources.segments import SegmentStore

TEXTS = ["Trains, trains and the rivers", "", "été RIVERS İstanbul Kelvin x a1B2", "running runs ran", "the of and", "rivers rivers running"]
POSTING = ["term", "doc_id", "tf_body", "tf_title", "doc_len"]


def rows_of(spark, n=1):
    return corpus(spark, [(i, f"https://a.test/{i}", TEXTS[(i + 1) % 6] if i % 2 else "", TEXTS[i % 6]) for i in range(6 * n)])


def slow_postings(docs):
    """The rule written out: words by Spark's own lower case and pattern, one row each."""
    words = [docs.select("doc_id", F.explode(index_words(F.col(c))).alias("word"), F.lit(c).alias("place")) for c in ("body", "title")]
    terms = ix.add_stem(words[0].unionByName(words[1]), "word", "term")
    counts = terms.groupBy("term", "doc_id").agg(*[F.count_if(F.col("place") == c).cast("int").alias(f"tf_{c}") for c in ("body", "title")])
    return counts.join(docs.select("doc_id", F.size(index_words(F.col("body"))).alias("doc_len")), "doc_id").select(*POSTING)


def test_lower_case_beyond_ascii_holds_two_letters(spark):
    chars = spark.range(0x80, 0x110000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert {r.id for r in chars.filter(F.lower("c").rlike("[a-z0-9]")).collect()} == {0x130, 0x212A}
    odd = ["İx Kb", "Aİb", "Ǆ ß ΑΣ x9", "KİK"]
    want = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).collect()
    assert {r.i: r.w for r in want} == {i: [w.decode() for w in ix._words(t.encode())] for i, t in enumerate(odd)}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 21])
def test_chunks_of_any_size_give_the_same_rows(spark, chunk):
    import pyarrow as pa

    docs = rows_of(spark, 3)
    kept = docs.filter(ix.skip_predicate(F.col("url"), F.col("body")))
    local = sorted(map(tuple, slow_postings(kept).collect()))
    batch = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, **dict.fromkeys(["url", "domain", "title", "snippet", "content_hash"], ""), "body": (r.body or "").encode(),
                                         "raw_title": (r.title or "").encode()} for r in kept.collect()])
    before, ix.CHUNK_WORDS = ix.CHUNK_WORDS, chunk
    try:
        out = [b.to_pylist() for b in ix._counted(iter([batch]))]
    finally:
        ix.CHUNK_WORDS = before
    runs = [r for b in out for r in b if r["term"] is not None]
    assert sorted((r["term"], *p) for r in runs for p in zip(*[r[c] for c in ix._LISTS], strict=True)) == local
    assert all(r["n_docs"] == len(r["doc_ids"]) for r in runs)
    if chunk > 7:
        assert len(runs) == len({r["term"] for r in runs})  # one row per term and chunk, not one per posting


def test_documents_and_postings_come_from_one_pass(spark):
    docs = rows_of(spark)
    kept = docs.filter(ix.skip_predicate(F.col("url"), F.col("body")))
    index = ix.build_index(docs)
    columns = ["doc_id", "url", "domain", "title", "snippet", "body_length", "content_hash"]
    assert sorted(map(str, index.documents.select(columns).collect())) == sorted(map(str, ix.build_documents(kept).select(columns).collect()))
    assert sorted(map(tuple, index.postings.select(POSTING).collect())) == sorted(map(tuple, slow_postings(kept).collect()))
    # no word is cut out of a text by an expression, for documents, their lengths or frequencies
    for table in (index.documents, index.stats, index.terms, index.postings):
        assert "regexp_extract_all" not in table._jdf.queryExecution().optimizedPlan().toString()
    # frequencies and lookups read runs: no posting is made for a term that is not asked
    assert "Generate" not in index.terms._jdf.queryExecution().optimizedPlan().toString()
    plan = index.matches(spark.createDataFrame([("river", 1)], "term string, number long"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_stored_and_segment_postings_are_the_runs_postings(spark, tmp_path):
    docs = rows_of(spark, 4).filter(F.length("body") > 0)
    want = sorted(map(tuple, slow_postings(docs).collect()))
    index_store.write_version(ix.build_index(docs), str(tmp_path / "a"), 1, docs_per_bucket=5, postings_per_bucket=16)
    stored = index_store.read_version(spark, str(tmp_path / "a"), 1)
    store = SegmentStore(spark, str(tmp_path / "b"), docs_per_bucket=5, postings_per_bucket=16, rows_per_file=20)
    store.apply(docs, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "one")
    for index in (stored, store.index()):
        assert sorted(map(tuple, index.postings.select(POSTING).collect())) == want
        assert {r.term: r.df for r in index.terms.collect()} == {t: sum(w[0] == t for w in want) for t in {w[0] for w in want}}
    for folder in ("a/version=1/postings", "b/segment=0/postings"):
        for file in (tmp_path / folder).rglob("*.parquet"):
            found = [(r.term, r.doc_id) for r in spark.read.parquet(str(file)).collect()]
            assert found == sorted(found)


def test_tables_by_document_are_written_by_as_many_tasks_as_their_words_need(spark, tmp_path):
    docs = corpus(spark, [(i, f"https://a.test/{i}", "", " ".join(f"w{i % 5}{j}x" for j in range(10))) for i in range(40)])
    store = SegmentStore(spark, str(tmp_path), rows_per_file=100)
    store.apply(docs, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "one")
    files = {t: [spark.read.parquet(str(f)).count() for f in (tmp_path / "segment=0" / t).rglob("*.parquet")] for t in ("terms_of", "documents", "postings")}
    # 400 postings of 40 documents: four files of either kind, not one with the terms of all documents
    assert len(files["terms_of"]) >= 3 and max(files["terms_of"]) <= 20
    assert len(files["documents"]) >= 5 and len(files["postings"]) >= 3
    assert sum(files["terms_of"]) == sum(files["documents"]) == 40 and sum(files["postings"]) == 400
    assert {r.doc_id: sorted(r.terms) for r in store.read(store.segments()[0], "terms_of").collect()} == {
        i: sorted(f"w{i % 5}{j}x" for j in range(10)) for i in range(40)}
