"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Tokenised documents become pieces of at most ``length`` tokens. Full pieces are sequences of their own. The
others are dealt into groups of a bounded size; each group is read longest first and every piece goes into the
open bin where the squared counts of open bins per remaining gap become smallest (a new bin only where none
fits). A group's state is one count a gap and the open bins, so it streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import CACHE_WORDS
from tidemark.llm.staging import staged

LENGTH = 1024
END_ID = 2
#: Pieces that are packed together; the groups' number grows with the input.
GROUP_PIECES = 16_384
_TEXTS = 256


def _pieces_of(ids: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, ids) of a document's pieces; only the first may be shorter than ``length``."""
    n = len(ids) // 4
    end = n % length or length
    start = 0
    while start < n:
        yield start, end - start, ids[4 * start : 4 * end]
        start, end = end, end + length


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, added_tokens: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids (little-endian unsigned 32-bit integers).

    A document is the ids of its whole text and ``end_id``; null text is empty and gives the end id alone.
    Repeated rows and null identifiers give their own pieces; an empty table gives none. ``added_tokens`` and ``cache_words`` as in ``bpe.Encoder``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from tidemark.llm.bpe import encoder

        encode = encoder(vocabulary, added_tokens, cache_words).encode
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                out = [(i, *p) for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()]))
                       for p in enumerate(_pieces_of(ids + end, length))]
                rows = pa.array([i for i, *_ in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.array([k for _, k, _ in out], pa.int32()), pa.array([p[0] for *_, p in out], pa.int64()),
                     pa.array([p[1] for *_, p in out], pa.int64()), pa.array([p[2] for *_, p in out], pa.binary())],
                    [id_col, "piece", "start", "length", "ids"])

    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


class _Bins:
    """Open bins of one group: how many there are per gap, and which."""

    def __init__(self, length: int):
        self.length, self.counts, self.made = length, np.zeros(length + 1, np.int64), 0
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``size`` tokens."""
        fits = np.flatnonzero(self.counts[size : self.length])  # by the gap that would remain
        if not len(fits):
            gap, number = self.length, self.made
            self.made += 1
        else:
            grown = 2 * (self.counts[fits] - self.counts[fits + size]) + 2
            if fits[0] == 0:  # a full bin is no longer counted
                grown[0] = 1 - 2 * self.counts[size]
            gap = int(fits[grown.argmin()]) + size
            number = self.open[gap].pop()
            self.counts[gap] -= 1
        if gap > size:
            self.open[gap - size].append(number)
            self.counts[gap - size] += 1
        return number, self.length - gap


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``length``) plus sequence_id and offset.

    Every sequence is filled from offset 0 without gaps and holds at most ``length`` tokens; its number has no
    meaning. Other columns pass through; columns of the input named sequence_id, offset, _place or _group are left out. Rows are told
    apart by their place in the staged table, so repeated rows and null identifiers are packed like any others. A task packs as many
    groups as its partition holds, one after the other, so the number of tasks follows the data's size and not the number of groups.
    """
    rows = staged(pieces.drop("sequence_id", "offset", "_place", "_group"), "pack-pieces").withColumn("_place", F.monotonically_increasing_id())
    full = rows.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.col("_place"), "offset": F.lit(0).cast("long")})
    short = rows.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_pieces))

    def run(batches):
        group, bins = None, _Bins(length)
        for batch in batches:
            own, at = batch.column("_group").to_pylist(), []
            for number, size in zip(own, batch.column("length").to_pylist(), strict=True):
                if number != group:
                    group, bins = number, _Bins(length)
                at.append(bins.place(size))
            numbers = np.array([n for n, _ in at], np.int64) + (np.array(own, np.int64) << 40)
            batch = batch.drop_columns(["_group"]).append_column("sequence_id", pa.array(numbers))
            yield batch.append_column("offset", pa.array([o for _, o in at], pa.int64()))

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_place"), F.lit(groups))).repartition("_group")
    dealt = dealt.sortWithinPartitions("_group", F.desc("length"), "_place")
    schema = T.StructType([*short.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema).unionByName(full).drop("_place")
