"""Re-index scenario over the stored ``pages`` table (R1-R5 end to end).

Version 1 is the index of a first crawl; version 2 applies a second crawl batch of every page, in which
the body of every fifth page has been revised. Pages not in the first crawl come back as ``inserted``,
revised pages as ``updated``, the rest as ``unchanged``. All of it is derived from the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import build_index, skip_predicate
from tidemark.operators.reindex import Reindex, delete_documents, reindex, stamp
from tidemark.operators.util import materialize
from tidemark.plans.pages import extract_pages, settle_versions

FIRST_CRAWL_AT = "2024-01-01 00:00:00"
SECOND_CRAWL_AT = "2024-01-02 00:00:00"
REVISION = "<p>revised edition</p></article>"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def first_crawl(pages: DataFrame) -> DataFrame:
    """Pages seen by the first crawl: all but those with page_id ending in 3."""
    return pages.filter(F.pmod(F.col("page_id"), F.lit(10)) != 3)


def second_crawl(pages: DataFrame) -> DataFrame:
    """Every page again; every fifth page's article gains a revised paragraph."""
    revised = F.when(F.pmod(F.col("page_id"), F.lit(5)) == 0,
                     F.replace(F.col("html"), F.lit("</article>"), F.lit(REVISION))).otherwise(F.col("html"))
    return pages.withColumn("html", revised)


def run(pages: DataFrame) -> Reindex:
    first = materialize(extract_pages(first_crawl(pages)).drop("links"))
    v1 = build_index(materialize(settle_versions(first)))
    v1_ts = stamp(v1.documents, ts(FIRST_CRAWL_AT))
    second = materialize(extract_pages(second_crawl(pages)).drop("links"))
    skipped = second.filter(~skip_predicate(F.col("url"), F.col("body_text"))).select(
        F.coalesce(F.col("url"), F.col("raw_url")).alias("url"))
    return reindex(v1, v1_ts, materialize(settle_versions(second)), ts(SECOND_CRAWL_AT), skipped)


def recrawled_same_id(pages: DataFrame) -> DataFrame:
    """Documents after one batch that holds every page twice under one id: as it was, and as the second crawl found it."""
    both = pages.withColumn("arrived_at", ts(FIRST_CRAWL_AT).cast("timestamp")).unionByName(
        second_crawl(pages).withColumn("arrived_at", ts(SECOND_CRAWL_AT).cast("timestamp"))).unionByName(
        second_crawl(pages).withColumn("arrived_at", ts(SECOND_CRAWL_AT).cast("timestamp")))
    return build_index(materialize(settle_versions(materialize(extract_pages(both).drop("links"))))).documents


def recrawled_moved_url(pages: DataFrame) -> Reindex:
    """A first crawl of the even pages; a second one in which each odd page carries the id of the even page before it."""
    even = pages.filter(F.pmod("page_id", F.lit(2)) == 0)
    odd = pages.filter(F.pmod("page_id", F.lit(2)) == 1).withColumn("page_id", F.col("page_id") - 1)
    v1 = build_index(materialize(settle_versions(materialize(extract_pages(even).drop("links")))))
    batch = materialize(settle_versions(materialize(extract_pages(odd).drop("links"))))
    return reindex(v1, stamp(v1.documents, ts(FIRST_CRAWL_AT)), batch, ts(SECOND_CRAWL_AT))


def with_deletions(pages: DataFrame):
    """The page index without the documents of every seventh page."""
    from tidemark.plans.pages import index_pages, url_id

    index = index_pages(pages)
    gone = extract_pages(pages.filter(F.pmod("page_id", F.lit(7)) == 0)).filter(F.col("url").isNotNull())
    return delete_documents(index, gone.select(url_id(F.col("url")).alias("doc_id")))


#: Parts in which the first crawl arrives at the segment store, which merges them.
ARRIVALS = 2


def segment_store(pages: DataFrame):
    """The scenario of ``run`` on a segment store: the first crawl in ARRIVALS batches (all pages of a url in one), then the second crawl."""
    import uuid

    from tidemark.session import ensure_checkpoint_dir
    from tidemark.sources.segments import SegmentStore

    spark = pages.sparkSession
    store = SegmentStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/segments-{uuid.uuid4().hex}", fanin=ARRIVALS)
    first = materialize(extract_pages(first_crawl(pages)).drop("links"))
    for k in range(ARRIVALS):
        part = first.filter(F.pmod(F.xxhash64("url"), F.lit(ARRIVALS)) == k)
        store.apply(settle_versions(part), ts(FIRST_CRAWL_AT), f"first crawl {k}")
    second = materialize(extract_pages(second_crawl(pages)).drop("links"))
    skipped = second.filter(~skip_predicate(F.col("url"), F.col("body_text"))).select(F.coalesce(F.col("url"), F.col("raw_url")).alias("url"))
    modes = store.apply(settle_versions(second), ts(SECOND_CRAWL_AT), "second crawl", skipped=skipped)
    return store, modes


def segments_without(pages: DataFrame):
    """R5 on a segment store: one batch of all pages, then the deletion of every seventh page's document."""
    import uuid

    from tidemark.plans.pages import page_corpus, url_id
    from tidemark.session import ensure_checkpoint_dir
    from tidemark.sources.segments import SegmentStore

    spark = pages.sparkSession
    store = SegmentStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/segments-{uuid.uuid4().hex}")
    corpus = page_corpus(pages)
    store.apply(corpus, ts(FIRST_CRAWL_AT), "all pages")
    gone = extract_pages(pages.filter(F.pmod("page_id", F.lit(7)) == 0)).filter(F.col("url").isNotNull()).select(url_id(F.col("url")).alias("doc_id"))
    store.apply(corpus.limit(0), ts(SECOND_CRAWL_AT), "deletions", gone=gone)
    return store
