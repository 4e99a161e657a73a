"""Stored index (SC5, SC6, §7.4).

Layout under a root folder (HDFS, object store or local):

    version=N/documents/doc_bucket=B/    parquet
    version=N/postings/term_bucket=B/    parquet, sorted by term inside each file, Bloom filters of the terms
    version=N/terms/term_bucket=B/       parquet: document frequency of every term
    version=N/stats/                     one-row parquet
    version=N/layout/                    one row: how many buckets of either kind this version has, chosen from its size
    versions/                            one row per complete version, written last

A writer that re-runs for the same version overwrites the same folders, so retries are idempotent.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.index import Index, corpus_stats, in_rows, run_frequencies, term_table
from tidemark.operators.util import bucket, buckets_for, materialize

#: Rows of one folder: some hundred megabytes of documents, about a gigabyte of postings.
DOCS_PER_BUCKET = 1 << 21
POSTINGS_PER_BUCKET = 1 << 26
#: How files that are looked up by term are written: row groups and pages of bounded rows, and a Bloom filter of each row
#: group's terms in the size that they need, so that a reader with terms in hand opens little else.
BY_TERM = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true",
           "parquet.block.row.count.limit": str(1 << 18), "parquet.page.row.count.limit": str(1 << 11)}


def _with(schema: T.StructType, bucket: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(bucket, T.IntegerType())])


def write_version(index: Index, root: str, version: int, documents: DataFrame | None = None,
                  docs_per_bucket: int = DOCS_PER_BUCKET, postings_per_bucket: int = POSTINGS_PER_BUCKET) -> str:
    """Writes one version; raises ValueError if two documents have one id."""
    base = f"{root.rstrip('/')}/version={version}"
    spark = index.postings.sparkSession
    docs = materialize((documents if documents is not None else index.documents).drop("doc_bucket"))
    # a document has at most as many postings as words
    n_docs, n_words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("body_length"), F.lit(0))).first()
    doc_buckets, term_buckets = buckets_for(n_docs, docs_per_bucket), buckets_for(n_words, postings_per_bucket)
    docs = docs.withColumn("doc_bucket", bucket(F.col("doc_id"), doc_buckets))
    # range partitions: as many tasks as the data has, a large bucket split over several, a small one in one file
    docs.repartitionByRange("doc_bucket", "doc_id").write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{base}/documents")
    stored = spark.read.parquet(f"{base}/documents")
    twice = stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if not twice.isEmpty():
        raise ValueError("two documents have one id")
    # range partitions on (bucket, term, doc_id): even file sizes, each task writes one or two bucket folders, a very common
    # term is split across tasks, and files are sorted by term for min/max skipping; runs are dealt and sorted as they are,
    # so that their postings come almost in order
    by_term = ["term_bucket", "term", "doc_id"]
    if index.runs is None:
        post = index.postings.drop("term_bucket").withColumn("term_bucket", bucket(F.col("term"), term_buckets)).repartitionByRange(*by_term)
    else:
        runs = index.runs.withColumns({"term_bucket": bucket(F.col("term"), term_buckets), "doc_id": F.get("doc_ids", F.lit(0))})
        post = in_rows(runs.repartitionByRange(*by_term).sortWithinPartitions(*by_term).drop("doc_id"), "term_bucket")
    post.sortWithinPartitions(*by_term).write.options(**BY_TERM).mode("overwrite").partitionBy("term_bucket").parquet(f"{base}/postings")
    terms = term_table(spark.read.parquet(f"{base}/postings").select("term", "doc_id")) if index.runs is None else run_frequencies(index.runs)
    terms = terms.withColumn("term_bucket", bucket(F.col("term"), term_buckets))
    terms.repartitionByRange("term_bucket", "term").sortWithinPartitions("term_bucket", "term").write.options(**BY_TERM).mode("overwrite").partitionBy("term_bucket").parquet(f"{base}/terms")
    # stats from the documents just written (a narrow column scan), not by re-running the build plan;
    # an index whose stats are maintained by deltas (re-index) writes those instead
    stats = index.stats if documents is not None else corpus_stats(stored)
    stats.select("doc_count", "total_length").coalesce(1).write.mode("overwrite").parquet(f"{base}/stats")
    spark.range(1).select(F.lit(doc_buckets).alias("doc_buckets"), F.lit(term_buckets).alias("term_buckets")).write.mode("overwrite").parquet(f"{base}/layout")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{root.rstrip('/')}/versions")
    return base


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    try:
        rows = spark.read.schema("version long").parquet(f"{root.rstrip('/')}/versions")
    except AnalysisException:  # nothing was written yet
        return []
    return sorted(r[0] for r in rows.distinct().collect())


def read_version(spark: SparkSession, root: str, version: int) -> Index:
    base = f"{root.rstrip('/')}/version={version}"
    doc_buckets, term_buckets = spark.read.schema("doc_buckets int, term_buckets int").parquet(f"{base}/layout").first()
    raw = spark.read.schema(schemas.INDEX_STATS).parquet(f"{base}/stats")
    stats = raw.select(
        "doc_count", "total_length",
        F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count")).otherwise(F.lit(0.0))
        .alias("avg_length"),
    )
    return Index(documents=spark.read.schema(_with(schemas.DOCUMENTS, "doc_bucket")).parquet(f"{base}/documents"),
                 postings=spark.read.schema(_with(schemas.POSTINGS, "term_bucket")).parquet(f"{base}/postings"),
                 stats=stats, terms=spark.read.schema("term string, df bigint, term_bucket int").parquet(f"{base}/terms"),
                 term_buckets=term_buckets, doc_buckets=doc_buckets)


def read_latest(spark: SparkSession, root: str) -> tuple[int, Index] | None:
    vs = versions(spark, root)
    if not vs:
        return None
    return vs[-1], read_version(spark, root, vs[-1])
