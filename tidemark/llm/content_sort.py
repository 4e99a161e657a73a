"""Exact deduplication by sorting content.

Rows are range-partitioned by sampled splitters over their normalised text, sorted inside each partition
with Spark's external sort, and neighbours are compared in full. The splitter key is a bounded prefix of
the text, then the text's SHA-256, then the identifier: a group of copies of any size may therefore spread
over many partitions. Only the first and last text of a partition can continue elsewhere; these edges (two
texts a partition) are grouped by their whole text and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.staging import staged
from tidemark.llm.words import squeezed

PREFIX_CHARS = 32
_OUT_ROWS = 8192


class _Run:
    """Neighbouring rows with one text: the parts of its batches, without the text itself."""

    __slots__ = ("number", "parts", "sha", "size", "text")

    def __init__(self, number: int, text: str, sha: str):
        self.number, self.text, self.sha, self.size, self.parts = number, text, sha, 0, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)
        self.size += rows.num_rows


def _runs(batches: Iterator[pa.RecordBatch], heads_only: bool) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ready: list[pa.Table] = []
    n_ready = number = 0
    block: list[_Run] = []  # runs of the digest being read; more than one only if digests collide
    first_sha = None

    def close(edge: bool) -> None:
        nonlocal n_ready
        for run in block:
            rows = pa.Table.from_batches(run.parts)
            n = rows.num_rows
            head = np.zeros(n, bool)
            head[0] = True
            keep = rows["id"][0]
            more = {
                "keep_id": pa.array([keep.as_py()] * n, rows.schema.field("id").type),
                "part": pa.array(np.full(n, part, np.int32)), "run": pa.array(np.full(n, run.number, np.int64)),
                "head": pa.array(head), "size": pa.array(np.full(n, run.size, np.int64)),
                "edge": pa.array([run.text if edge else None] + [None] * (n - 1), pa.string()),
            }
            for name, values in more.items():
                rows = rows.append_column(name, values)
            ready.append(rows)
            n_ready += n
        block.clear()

    def drain() -> Iterator[pa.RecordBatch]:
        nonlocal n_ready
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches(max_chunksize=_OUT_ROWS)
        ready.clear()
        n_ready = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, sha = batch.column("norm"), batch.column("sha")
        rows = batch.drop_columns(["norm"])
        same = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        ends = np.append(starts[1:], batch.num_rows)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if s == 0 and block and block[-1].text == norm[0].as_py():
                run = block[-1]
                if heads_only:
                    run.size += e - s
                    continue
            else:
                digest = sha[s].as_py()
                if block and block[0].sha != digest:
                    close(edge=block[0].sha == first_sha)
                first_sha = first_sha or digest
                run = _Run(number, norm[s].as_py(), digest)
                number += 1
                block.append(run)
                if heads_only:
                    run.add(rows.slice(s, 1))
                    run.size = e - s
                    continue
            run.add(rows.slice(s, e - s))
        if n_ready >= _OUT_ROWS:
            yield from drain()
    close(edge=True)
    yield from drain()


def _sorted_runs(docs: DataFrame, id_col: str, text: Column, carry: bool) -> DataFrame:
    first = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(*first, F.col(f"`{id_col}`").alias("id"), squeezed(text).alias("norm"))
    rows = rows.withColumn("prefix", F.substring("norm", 1, PREFIX_CHARS)).withColumn("sha", F.sha2("norm", 256))
    rows = rows.repartitionByRange(F.asc("prefix"), F.asc("sha"), F.asc_nulls_last("id")).sortWithinPartitions(
        F.asc("prefix"), F.asc("sha"), F.asc("norm"), F.asc_nulls_last("id"))
    rows = rows.select(*(["row"] if carry else []), "id", "sha", "norm")
    fields = [rows.schema[c] for c in rows.columns if c != "norm"]
    schema = T.StructType([*fields, T.StructField("keep_id", rows.schema["id"].dataType), T.StructField("part", T.IntegerType()),
                           T.StructField("run", T.LongType()), T.StructField("head", T.BooleanType()),
                           T.StructField("size", T.LongType()), T.StructField("edge", T.StringType())])

    return staged(rows.mapInArrow(lambda batches: _runs(batches, heads_only=carry), schema), "content-sort")


def _edges(runs: DataFrame) -> DataFrame:
    """For each run at an edge: the first run, smallest identifier and size of its whole text."""
    edge = runs.where("edge is not null").select("edge", "part", "run", F.col("id").alias("edge_id"), "size")
    whole = edge.groupBy("edge").agg(F.min("edge_id").alias("edge_keep"), F.sum("size").alias("edge_size"),
                                     F.min(F.struct("part", "run")).alias("edge_first"))
    # at most two texts a partition (more only if digests collide), so the result is as small as the partition count
    small = edge.join(whole, "edge").select("part", "run", "edge_keep", "edge_size", "edge_first")
    return F.broadcast(staged(small, "content-edges"))


def _is_first() -> Column:
    return F.col("head") & (F.col("edge_first").isNull() | (F.col("edge_first") == F.struct("part", "run")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run became one blank. Null text counts as empty; a
    null identifier sorts last, so it stays only where its group has no other. Of repeated rows (same
    identifier and text) exactly one is kept. An empty table gives an empty result. Other columns are ignored.
    """
    runs = _sorted_runs(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, F.col(f"`{text_col}`"), carry=False)
    out = runs.join(_edges(runs), ["part", "run"], "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("edge_keep", "keep_id").alias("keep_id"),
        F.coalesce("edge_size", "size").alias("group_size"), _is_first().alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that ``exact_groups`` does not keep."""
    runs = _sorted_runs(docs, id_col, F.col(f"`{text_col}`"), carry=True)
    return runs.join(_edges(runs), ["part", "run"], "left").where(_is_first()).select("row.*")
