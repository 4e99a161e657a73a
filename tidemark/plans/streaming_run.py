"""Drive the ingest stream over a table split into arrival files (used by tests and the registry)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.urls import add_normalized_url
from tidemark.operators.index import Index
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.segments import SegmentStore
from tidemark.streaming import ingest

ARRIVALS = 4


def split_into_files(pages: DataFrame, path: str, arrivals: int = ARRIVALS) -> int:
    """Write ``pages`` in one pass as files that each hold all pages of their urls, so that the files may arrive in any order.

    Returns the number of files: one per shuffle partition, one per arrival at least. Every page goes to a file, whatever its id.
    """
    files = max(arrivals, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = add_normalized_url(pages, "url", None, "_canonical").repartition(files, "_canonical")
    dealt.drop("_canonical").write.parquet(path)
    return files


def stream_pages(spark: SparkSession, pages: DataFrame, arrivals: int = ARRIVALS, files_per_batch: int | None = None) -> Index:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    files = split_into_files(pages, f"{root}/arrivals", arrivals)
    q = ingest.start(spark, f"{root}/arrivals", f"{root}/index", f"{root}/checkpoint", max_files_per_trigger=files_per_batch or -(-files // arrivals))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return SegmentStore(spark, f"{root}/index").index()
