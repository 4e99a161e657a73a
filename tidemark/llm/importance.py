"""Importance resampling towards a target collection, over hashed word n-grams.

Texts are read in batches: a batch's texts are joined with a separator, one pass of the word pattern over the joined bytes finds
all words, their documents come from a sorted search in the texts' offsets, and an n-gram whose two ends lie in different documents
is masked out. The buckets of a document's n-grams are written once; counting them (bincount in the tasks, one row a bucket from
there) and weighing documents read that table, so a text is read once. The draw is a Gumbel top-k: weight plus a hashed Gumbel
value, the highest scores first, numbered over a range-partitioned sort.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.staging import staged

#: Words of the joined, lower-cased UTF-8 bytes; every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\x00"
#: Text that a task joins at a time (one longer text stands alone) and words that it holds at a time.
BATCH_BYTES = 1 << 22
BATCH_WORDS = 1 << 18
GUMBEL_SCALE = 1000


def byte_batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices with at most ``limit`` bytes, one row at least; null is empty."""
    first, held, size = 0, [], 0
    for row, text in enumerate(column.cast(pa.large_binary()).to_pylist()):
        text = text or b""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = row, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def hashed_features(texts: list[bytes], n_buckets: int, max_words: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, documents, buckets) of the runs of n = 1 to ``max_words`` consecutive words of one text, in portions."""
    joined = SEPARATOR.join(texts).lower()  # bytes: A-Z only
    offsets = np.cumsum([0, *[len(t) + len(SEPARATOR) for t in texts[:-1]]])
    found = WORD.finditer(joined)
    words: list[bytes] = []
    docs = np.empty(0, np.int64)
    while part := list(islice(found, BATCH_WORDS)):
        known = len(words)  # words of the last portion that may start a run ending in this one
        words += [m.group() for m in part]
        starts = np.fromiter((m.start() for m in part), np.int64, len(part))
        docs = np.concatenate((docs, np.searchsorted(offsets, starts, side="right") - 1))
        crc_of = {w: zlib.crc32(w) for w in set(words)}
        crcs = np.fromiter(map(crc_of.__getitem__, words), np.int64, len(words))
        for n in range(1, max_words + 1):
            if n > 1:
                longer = zip(words[n - 1 :], crcs.tolist(), strict=False)
                crcs = np.fromiter((zlib.crc32(b" " + w, crc) for w, crc in longer), np.int64, max(0, len(words) - n + 1))
            first = max(0, known - n + 1)
            inside = np.flatnonzero(docs[first : len(crcs)] == docs[first + n - 1 :]) + first
            yield n, docs[inside], crcs[inside] % n_buckets
        keep = max_words - 1
        words, docs = (words[-keep:], docs[-keep:]) if keep else ([], docs[:0])


def _bucket_type(n_buckets: int) -> str:
    return "<u2" if n_buckets <= 1 << 16 else "<u4"


def bucket_table(docs: DataFrame, id_col: str, text_col: str, n_buckets: int, max_words: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features and the features' buckets as packed integers."""
    packed = _bucket_type(n_buckets)

    def run(batches):
        for batch in batches:
            for first, texts in byte_batches(batch.column(1)):
                n_words, where, what = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for n, rows, buckets in hashed_features(texts, n_buckets, max_words):
                    if n == 1:
                        n_words += np.bincount(rows, minlength=len(texts))
                    where.append(rows)
                    what.append(buckets)
                rows = np.concatenate(where)
                raw = np.concatenate(what)[np.argsort(rows, kind="stable")].astype(packed).tobytes()
                n_features = np.bincount(rows, minlength=len(texts))
                at = (np.concatenate(([0], np.cumsum(n_features))) * np.dtype(packed).itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n_words), pa.array(n_features),
                     pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                    ["id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
                           T.StructField("buckets", T.BinaryType())])
    return staged(rows.mapInArrow(run, schema), "feature-buckets")


def _values(column: pa.Array, packed: str) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch in a row, and the place after each row's last."""
    rows = [np.frombuffer(v, packed) for v in column.to_pylist()]
    ends = np.cumsum([len(r) for r in rows])
    return (np.concatenate(rows) if rows else np.empty(0, packed)).astype(np.int64), ends


def bucket_counts(table: DataFrame, n_buckets: int) -> np.ndarray:
    """Features per bucket over the whole table. The driver receives one row a bucket, however large the table is."""
    packed = _bucket_type(n_buckets)

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0), packed)[0], minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for bucket, n in table.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of every bucket."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def with_weights(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """``table`` with the floored mean of its features' gains instead of the buckets; 0 where there is none."""
    packed = _bucket_type(len(gains))

    def run(batches):
        for batch in batches:
            values, ends = _values(batch.column(3), packed)
            sums = np.diff(np.concatenate(([0], np.cumsum(gains[values])))[np.concatenate(([0], ends)).astype(np.int64)])
            n = batch.column(2).to_numpy()
            yield batch.drop_columns(["buckets"]).append_column("weight", pa.array(sums // np.maximum(n, 1)))

    schema = T.StructType([*[f for f in table.schema.fields if f.name != "buckets"], T.StructField("weight", T.LongType())])
    return table.mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """A whole number: floor(-1000 ln(-ln u)) of a hashed uniform u."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with a column number: 1, 2, 3 ... in the given order. Every task numbers its own range; the ranges' sizes are added up."""
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.arange(n + 1, n + 1 + batch.num_rows)
            n += batch.num_rows
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int64))).append_column("own", pa.array(own))

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("own", T.LongType())])
    dealt = rows.withColumn("place", F.monotonically_increasing_id())  # rows that tie in every key may still be split
    dealt = dealt.repartitionByRange(*order, "place").sortWithinPartitions(*order, "place").drop("place")
    out = staged(dealt.mapInArrow(run, schema), "numbered")
    sizes = out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return out.join(before, "part").withColumn("number", F.col("before") + F.col("own")).drop("part", "own", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             n_buckets: int = 10_000, max_words: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every row of ``docs`` as ``id_col``, n_words, n_features, weight, score, rank (null where it was not drawn).

    Drawn are the floor(percent * N / 100) highest scores of the N rows with at least ``least_words`` words; ties go to the smaller
    identifier, then to more features. Null and empty texts have no feature and weight 0. A null identifier is hashed as an
    empty one and sorts last; repeated rows each count, tie, and take ranks of their own. Empty tables are allowed on either
    side. Other columns are ignored.
    """
    table = bucket_table(docs, id_col, text_col, n_buckets, max_words)
    wanted = bucket_table(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", n_buckets, max_words)
    gains = bucket_gains(bucket_counts(table, n_buckets), bucket_counts(wanted, n_buckets))
    scored = staged(with_weights(table, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    fits = F.col("n_words") >= least_words
    ranked = numbered(scored.where(fits), [F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features")])
    draw = scored.agg(F.floor(F.lit(percent) * F.count_if(fits) / 100).alias("n")).select("n").scalar()
    ranked = ranked.withColumn("rank", F.when(F.col("number") <= draw, F.col("number"))).drop("number")
    out = ranked.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
