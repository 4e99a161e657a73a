"""Small plan helpers shared by the operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(key: Column, buckets: int) -> Column:
    """The folder number of a key among ``buckets`` folders."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    """How many folders hold ``rows`` rows: a power of two, so that every number in use divides every larger one."""
    return 1 << max(0, (max(1, -(-rows // rows_per_bucket)) - 1).bit_length())


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: ``df`` as Parquet in the session's shared folder, read back.

    Later reads prune columns, the planner knows the real size, and a lost executor costs one read.
    """
    from tidemark.session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_shared(uri: str):
    """A file of ``DataFrame.inputFiles``, opened for reading by a task (file, hdfs, s3, gs, or a plain path)."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?=[^/])", "file:///", uri))
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)
