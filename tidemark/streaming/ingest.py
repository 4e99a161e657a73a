"""Continuous re-index with Structured Streaming (ST1, ST2).

Arriving page files are read with ``readStream`` (``maxFilesPerTrigger`` bounds a micro-batch, the
batch form of the crawler's page budget); ``foreachBatch`` extracts and settles a micro-batch (a url's pages count in order of
arrival, also inside a batch) and applies it to a segment store: it writes one segment of the batch's own size. The stored segments are
the seen-url state (ST2): their sketches tell new ids from possible old ones, so no unbounded streaming state is kept and no
stored bucket is opened for a new url. The batch's clock is the newest modification time of its files and its name the batch id, so a
batch replayed after a failure writes the same segment, or nothing if it was committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.index import skip_predicate
from tidemark.operators.util import materialize
from tidemark.plans.pages import extract_pages, settle_versions
from tidemark.sources.segments import SegmentStore


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, index_root: str, as_of=None) -> None:
    store, name = SegmentStore(spark, index_root), f"batch {batch_id}"
    if store.applied(name):
        return
    if as_of is None:
        # the batch's clock is the newest arrival time of its files: a replay of the batch after a failure
        # sees the same files and writes the same rows
        as_of = (batch.select(F.max("arrived_at").cast("timestamp_ntz")).scalar() if "arrived_at" in batch.columns
                 else F.current_timestamp().cast("timestamp_ntz"))
    extracted = materialize(extract_pages(batch).drop("links"))
    skipped = extracted.filter(~skip_predicate(F.col("url"), F.col("body_text"))).select(
        F.coalesce(F.col("url"), F.col("raw_url")).alias("url"))
    store.apply(settle_versions(extracted), as_of, name, skipped=skipped)


def start(spark: SparkSession, source_dir: str, index_root: str, checkpoint: str, max_files_per_trigger: int = 1,
          available_now: bool = True):
    """Start the ingest stream; returns the StreamingQuery."""
    stream = (spark.readStream.schema(schemas.INPUT["pages"]).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir)
              .select("*", F.col("_metadata.file_modification_time").alias("arrived_at")))
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: process_batch(spark, df, bid, index_root)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()
