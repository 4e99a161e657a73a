"""Incremental re-index (R1-R5, J6, T5, SC5, SC6).

Given the stored index and a settled batch (one row per canonical url, see ``plans.pages``), each url of
the batch gets a mode by comparing body hashes with the stored document (J6 left join on url):

    inserted   url not stored                 length_delta = new length
    updated    stored, body hash differs      length_delta = new - old; postings replaced (R2)
    unchanged  stored, same body hash         only crawled_at moves; title/snippet stay (K4, R4)

Pages of the batch that fail the skip predicate are reported as ``skipped``. The new state is built
without touching unchanged data: documents by a keyed merge, postings by an anti-join on the replaced
documents plus the postings of inserted/updated ones, statistics by adding the deltas (R3), which equals
recomputing them (test invariant).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import Index, build_documents, build_postings, corpus_stats, term_table


@dataclass
class Reindex:
    modes: DataFrame      # (url, doc_id, mode, length_delta)
    index: Index          # next version
    documents_ts: DataFrame  # next documents with crawled_at / updated_at


def stamp(documents: DataFrame, as_of: Column) -> DataFrame:
    """Initial timestamps for a freshly built index."""
    return documents.withColumn("crawled_at", as_of).withColumn("updated_at", as_of)


def reindex(old: Index, old_documents_ts: DataFrame, batch: DataFrame, as_of: Column,
            skipped: DataFrame | None = None) -> Reindex:
    """``batch``: settled corpus rows (doc_id, url, domain, title, snippet, body) of this crawl batch."""
    new_docs = build_documents(batch)
    stored = old_documents_ts.select(
        "url", F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash"),
        F.col("body_length").alias("old_len"), F.col("title").alias("old_title"),
        F.col("snippet").alias("old_snippet"), F.col("updated_at").alias("old_updated"),
    )
    j = new_docs.join(stored, "url", "left")
    mode = (
        F.when(F.col("old_id").isNull(), F.lit("inserted"))
        .when(F.col("content_hash") == F.col("old_hash"), F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    j = j.withColumn("mode", mode).withColumn("doc_id", F.coalesce(F.col("old_id"), F.col("doc_id")))
    delta = (
        F.when(F.col("mode") == "inserted", F.col("body_length"))
        .when(F.col("mode") == "updated", F.col("body_length") - F.col("old_len"))
        .otherwise(F.lit(0))
    )
    j = j.withColumn("length_delta", delta.cast("long"))
    modes = j.select("url", "doc_id", "mode", "length_delta")
    if skipped is not None:
        modes = modes.unionByName(skipped.select(
            "url", F.lit(None).cast("long").alias("doc_id"), F.lit("skipped").alias("mode"),
            F.lit(0).cast("long").alias("length_delta")))

    unchanged = F.col("mode") == "unchanged"
    touched = j.select(
        "doc_id", "url", "domain",
        F.when(unchanged, F.col("old_title")).otherwise(F.col("title")).alias("title"),
        F.when(unchanged, F.col("old_snippet")).otherwise(F.col("snippet")).alias("snippet"),
        F.when(unchanged, F.col("old_len")).otherwise(F.col("body_length")).alias("body_length"),
        F.when(unchanged, F.col("old_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        as_of.alias("crawled_at"),
        F.when(unchanged, F.col("old_updated")).otherwise(as_of).alias("updated_at"),
    )
    # SC5: keyed merge on url (untouched stored rows + the batch's rows)
    docs_ts = old_documents_ts.join(touched.select("url"), "url", "left_anti").unionByName(touched)

    # Drop postings of replaced documents, add postings of inserted and updated ones
    changed = j.filter(~unchanged).select("doc_id", "url")
    fresh = batch.drop("doc_id").join(changed, "url")
    postings = old.postings.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(
        build_postings(fresh.select("doc_id", "url", "domain", "title", "snippet", "body"))
    )
    documents = docs_ts.drop("crawled_at", "updated_at")
    # Statistics by delta
    deltas = modes.agg(
        F.count_if(F.col("mode") == "inserted").cast("long").alias("d_docs"),
        F.coalesce(F.sum("length_delta"), F.lit(0)).cast("long").alias("d_len"),
    )
    stats = old.stats.select(
        (F.col("doc_count") + deltas.select("d_docs").scalar()).alias("doc_count"),
        (F.col("total_length") + deltas.select("d_len").scalar()).alias("total_length"),
    )
    stats = stats.select(
        "doc_count", "total_length",
        F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count")).otherwise(F.lit(0.0))
        .alias("avg_length"),
    )
    return Reindex(modes=modes, index=Index(documents=documents, postings=postings, stats=stats, terms=term_table(postings)),
                   documents_ts=docs_ts)


def delete_documents(old: Index, gone: DataFrame) -> Index:
    """The index without the documents of ``gone`` (doc_id), their postings and their share of the statistics.

    Ids that are not stored change nothing; ids that occur twice count once.
    """
    ids = gone.select("doc_id").distinct()
    removed = old.documents.join(ids, "doc_id", "left_semi").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("body_length"), F.lit(0)).cast("long").alias("length"))
    stats = old.stats.select(
        (F.col("doc_count") - removed.select("n").scalar()).alias("doc_count"),
        (F.col("total_length") - removed.select("length").scalar()).alias("total_length"))
    stats = stats.select("doc_count", "total_length", F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count"))
                         .otherwise(F.lit(0.0)).alias("avg_length"))
    postings = old.postings.join(ids, "doc_id", "left_anti")
    return Index(documents=old.documents.join(ids, "doc_id", "left_anti"), postings=postings, stats=stats, terms=term_table(postings))


def recomputed_stats(index: Index) -> DataFrame:
    """A5 over the stored documents, for the R3 invariant."""
    return corpus_stats(index.documents)
