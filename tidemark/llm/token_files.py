"""Documents as token ids in wavelet-matrix files, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.files import make_folder, write_whole
from tidemark.llm.staging import staged

END_ID = 2
#: A task writes a file whenever it holds this many ids, so its memory doesn't grow with its partition.
SHARD_IDS = 1 << 20
_TEXTS = 256


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS, added_tokens: bool = False) -> DataFrame:
    """Writes every document's ids and ``end_id`` in ascending ``id_col`` order, ties by text; returns the files' index.

    Index: name, part, shard, first (ids in all files before), n_ids, n_docs. Null text is empty; null identifiers
    come last; repeated rows are written as often as they occur; an empty table writes no file. ``added_tokens`` as in ``bpe.Encoder``.
    """
    make_folder(folder)
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.asc_nulls_last("id")).sortWithinPartitions(F.asc_nulls_last("id"), "text")

    def run(batches):
        from tidemark.llm import wavelet
        from tidemark.llm.bpe import encoder

        encode, part, shard = encoder(vocabulary, added_tokens).encode, TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            starts = np.cumsum([0, *[len(t) // 4 for t in tokens]])
            known = np.array([0 if i is None else i for i in ids], np.int64)
            data = wavelet.build(np.frombuffer(b"".join(tokens), "<u4"), known, starts, nulls=ids.count(None), part=part, shard=shard)
            name = f"part-{part:06d}-{shard:06d}.wvm"
            write_whole(folder, name, data)
            out = pa.RecordBatch.from_pylist([{"name": name, "part": part, "shard": shard, "n_ids": held, "n_docs": len(ids)}])
            ids.clear()
            tokens.clear()
            shard, held = shard + 1, 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                piece = batch.slice(at, _TEXTS)
                for one, found in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(one)
                    tokens.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= shard_ids:
                        yield close()
        if ids:
            yield close()

    index = staged(rows.mapInArrow(run, "name string, part bigint, shard bigint, n_ids bigint, n_docs bigint"), "token-files")
    # one row a task, then the files of each task: no window sees more than the number of tasks or of one task's files
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(parts, "part").withColumn("first", F.col("before") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).drop("before")


def read_token_files(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """One row per document from the files of ``index``: id, start (ids of all documents before), ids (bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = files.join(staged(index.select("name", "first"), "token-index"), "name")  # one short row a file; the planner sees its size

    def run(batches):
        from tidemark.llm.wavelet import Shard

        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("first"), strict=True):
                shard = Shard(content.as_buffer().to_pybytes())
                raw = shard.all_ids().astype("<u4").tobytes()
                at = (4 * shard.starts).tolist()
                ids = pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.null_docs), pa.array(shard.starts[:-1] + first.as_py()), ids], ["id", "start", "ids"])

    return files.mapInArrow(run, "id bigint, start bigint, ids binary")

