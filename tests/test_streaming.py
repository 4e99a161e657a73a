import pytest


@pytest.mark.parametrize("files_per_batch", [4, 8])
def test_stream_equals_batch(spark, files_per_batch):
    from tidemark.plans.pages import index_pages
    from tidemark.plans.streaming_run import stream_pages

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    streamed = stream_pages(spark, pages, files_per_batch=files_per_batch)
    batch = index_pages(pages)
    cols = ["term", "doc_id", "tf_body", "tf_title"]
    assert sorted(map(tuple, streamed.postings.select(cols).collect())) == \
        sorted(map(tuple, batch.postings.select(cols).collect()))
    stamps = {r.crawled_at for r in streamed.documents.select("crawled_at").distinct().collect()}
    assert stamps and None not in stamps


def test_recrawled_ids_in_one_batch(spark, tmp_path):
    """Two files in one batch hold the same page_id with different bodies: the later file counts."""
    from tidemark.sources.segments import SegmentStore
    from tidemark.streaming import ingest

    schema = "page_id long, url string, html string"
    for body in ("first words", "second words"):
        spark.createDataFrame([(7, "https://x.test/a", f"<body>{body}</body>")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "cp"), max_files_per_trigger=2)
    q.awaitTermination()
    index = SegmentStore(spark, str(tmp_path / "index")).index()
    assert sorted(r.term for r in index.postings.filter("tf_body > 0").collect()) == ["second", "word"]
    assert index.documents.count() == 1
