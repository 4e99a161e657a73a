"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. One pass over all texts gives each document its set of word shingles, as a 128-bit key, and a MinHash signature.
   Documents with equal sets are one node.
2. Nodes that agree on a band of the signature share a bucket; buckets with the same members are read once. Inside a bucket,
   signatures are compared a few hashes at a time, and a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below the tolerance. What remains ties nodes into groups.
3. Inside a group, every pair that shares a shingle is verified on the whole sets.

A large bucket or group is cut into blocks and worked on by pairs of blocks, so no task ever holds more than two blocks.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.runs import groups
from tidemark.llm.shingles import HASHES, WORDS, set_key, shingle_set, signature
from tidemark.llm.staging import staged
from tidemark.llm.words import squeezed, text_or_empty

THRESHOLD = 0.8
TOLERANCE = 1e-6
#: Hashes a band: a pair at the threshold shares none of 32 bands with probability (1 - 0.8**4)**32, about 5e-8.
BAND_HASHES = 4
STEP = 16
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 20
#: Parts, by a hash of the node, that a bucket's or a group's members are dealt into where they are joined with its number of blocks.
PARTS = 16


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(n, m): after n hashes a pair with fewer than m equal ones is dropped.

    With a uniform prior, m equal ones of n leave a Beta(m + 1, n - m + 1); its tail from t on is the probability that
    a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


class _Ties:
    """Union-find over one block's rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def tie(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def _survivors(signs: np.ndarray, i: int, others: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Of ``others``, the rows that the pruning leaves as partners of row ``i``."""
    equal, done = np.zeros(len(others), np.int64), 0
    for n, least in steps:
        equal += (signs[others, done:n] == signs[i, done:n]).sum(axis=1)
        keep = equal >= least
        others, equal, done = others[keep], equal[keep], n
        if not len(others):
            break
    return others


def _tie_bucket(table: pa.Table, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    nodes = table["node"].to_numpy()
    block = table["block"].to_numpy()
    cross = table["i"][0].as_py() != table["j"][0].as_py()
    signs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(nodes), HASHES)
    ties = _Ties(len(nodes))
    for i in range(len(nodes) - 1):
        others = np.arange(i + 1, len(nodes))
        if cross:
            others = others[block[others] != block[i]]
        others = others[ties.up[others] != ties.find(i)]
        for j in _survivors(signs, i, others, steps).tolist():
            ties.tie(i, j)
    roots = ties.roots()
    some = roots != np.arange(len(nodes))
    return nodes[some], nodes[roots[some]]


def _verify(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Per row of a block pair: how many documents it links to, and a node of its own verified group."""
    nodes, weight, block = (table[c].to_numpy() for c in ("node", "n_docs", "block"))
    cross = table["i"][0].as_py() != table["j"][0].as_py()
    raw = table["shingles"].to_pylist()
    sizes = np.array([len(r) // 8 for r in raw], np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    _, local = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
    by_shingle = np.argsort(local, kind="stable")
    first = np.searchsorted(local[by_shingle], np.arange(int(local.max(initial=-1)) + 2))
    holders = owner[by_shingle]
    at = np.concatenate(([0], np.cumsum(sizes)))
    links, ties = np.zeros(len(nodes), np.int64), _Ties(len(nodes))
    for i in range(len(nodes) - 1):
        own = local[at[i] : at[i + 1]]
        start, count = first[own], first[own + 1] - first[own]
        own, start, count = own[count > 1], start[count > 1], count[count > 1]
        if not len(own):
            continue
        ends = np.cumsum(count)
        places = np.arange(ends[-1]) + np.repeat(start - np.concatenate(([0], ends[:-1])), count)
        shared = np.bincount(holders[places], minlength=len(nodes))
        shared[: i + 1] = 0
        if cross:
            shared[block == block[i]] = 0
        others = np.flatnonzero(shared)
        both = shared[others]
        others = others[both / (sizes[i] + sizes[others] - both) >= threshold]
        links[i] += weight[others].sum()
        links[others] += weight[i]
        for j in others.tolist():
            ties.tie(i, j)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[ties.roots()])], ["node", "links", "tied"])


def _in_parts(sizes: DataFrame) -> DataFrame:
    """``sizes`` (one narrow row a group) once for every part, so that the members of a large group can meet it in several tasks."""
    return sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _part(node: str) -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit("part")), F.lit(PARTS)).cast("int")


def _blocks(members: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """``members`` (by, node, ...) with block, i and j: one row per pair of blocks that the member takes part in.

    ``sizes`` has ``by`` and n_blocks. A group of one block gives one row a member.
    """
    # the same join at every size: a broadcast that only small inputs get would hide what large ones shuffle
    rows = members.withColumn("part", _part("node")).join(_in_parts(sizes).hint("merge"), [by, "part"]).drop("part")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("n_blocks", "other")


def _by_unit(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j", "node")


def _text_key(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per input row: id, text_key, set key, n_shingles and signature; the last three null for a text without words."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _text_key(F.col(f"`{text_col}`")).alias("text_key"), squeezed(F.col(f"`{text_col}`")).alias("text"))

    def run(batches):
        for batch in batches:
            keys, sizes, signs = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text)
                some = len(found) > 0
                keys.append(set_key(found) if some else None)
                sizes.append(len(found) if some else None)
                signs.append(signature(found) if some else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                ["id", "text_key", "set_key", "n_shingles", "sig"])

    schema = T.StructType([rows.schema["id"], rows.schema["text_key"], T.StructField("set_key", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())])
    return staged(rows.mapInArrow(run, schema), "signatures")


def _nodes(signed: DataFrame) -> DataFrame:
    """One row per distinct set of shingles: node, set_key, rep_id and rep_key (of its first document), n_docs, n_shingles, sig."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("rep")
    per = signed.where("set_key is not null").groupBy("set_key").agg(
        first, F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return staged(per.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("rep.id").alias("rep_id"),
                             F.col("rep.text_key").alias("rep_key"), "n_docs", "n_shingles", "sig"), "nodes")


def _candidate_groups(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, label) of the nodes that have a partner which the pruning leaves."""
    n_bands = HASHES // BAND_HASHES
    width = 2 * BAND_HASHES
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.xxhash64(b, F.substr("sig", b * width + 1, F.lit(width))))
    rows = nodes.select("node", F.explode(keys).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"),
                                       F.bit_xor(F.xxhash64("node", F.lit("2"))).alias("who2")).where("n > 1")
    # buckets of different bands with the same members give the same pairs
    once = staged(sizes.groupBy("n", "who", "who2").agg(F.min("bucket").alias("bucket")), "buckets")
    once = once.select("bucket", F.ceil(F.col("n") / BLOCK_NODES).alias("n_blocks"))
    units = _blocks(rows, "bucket", once).join(nodes.select("node", "sig"), "node")
    steps = least_matches(threshold, tolerance)

    def run(batches):
        for table in groups(batches, ["bucket", "i", "j"]):
            u, v = _tie_bucket(table, steps)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return staged(components(_by_unit(units, "bucket").mapInArrow(run, "u bigint, v bigint")), "candidates")


def _verified(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Per block pair and node: links (documents) and tied (a node of the same verified group)."""
    members = staged(candidates.join(nodes.drop("sig"), "node"), "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.select("label", F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).alias("n_blocks"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), _text_key(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    own = members.select("label", "node", "n_docs", "rep_id", "rep_key")
    own = own.hint("merge").join(texts, texts["id"].eqNullSafe(own["rep_id"]) & (texts["text_key"] == own["rep_key"]))

    def shingled(batches):
        for batch in batches:
            sets = pa.array([shingle_set(t).astype("<u8").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield batch.drop_columns(["text"]).append_column("shingles", sets)

    own = own.select("label", "node", "n_docs", squeezed(F.col("text")).alias("text"))
    own = own.mapInArrow(shingled, "label bigint, node bigint, n_docs bigint, shingles binary")
    units = _by_unit(_blocks(own, "label", sizes), "label")

    def run(batches):
        for table in groups(batches, ["label", "i", "j"]):
            table = _once(table)
            if table.num_rows > 1:
                yield _verify(table, threshold)

    return staged(units.mapInArrow(run, "node bigint, links bigint, tied bigint"), "verified")


def _once(table: pa.Table) -> pa.Table:
    """Without repeats of a node, which repeated input rows give; nodes are sorted."""
    node = table["node"].to_numpy()
    keep = np.append(True, node[1:] != node[:-1])
    return table if keep.all() else table.filter(pa.array(keep))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: ``id_col``, class_id, n_links, first.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of ``threshold`` or more; words are
    runs of other characters than white space. n_links counts the other documents that a document is linked to (copies
    included); class_id is the smallest identifier among all documents tied by links; ``first`` marks one row of each
    class, the one with the smallest identifier. A text of one to four words is one shingle. A null text and one without words has no
    shingle, no link and a class of its own. Null identifiers sort last, so a class has a null class_id only where all its
    identifiers are null. Repeated rows are copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    signed = _signed(docs, id_col, text_col)
    nodes = _nodes(signed)
    verified = _verified(docs, id_col, text_col, nodes, _candidate_groups(nodes, threshold, tolerance), threshold)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labels = staged(components(verified.select(F.col("node").alias("u"), F.col("tied").alias("v"))), "labels")

    own = nodes.select("node", "set_key", "rep_id", "n_docs").join(links, "node", "left").join(labels, "node", "left")
    own = own.withColumn("label", F.coalesce("label", "node"))
    smallest = own.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), F.col("rep_id").alias("id"))).alias("low"))
    own = own.join(smallest, "label").select(
        "set_key", F.col("low.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), "label")
    rows = signed.select("id", "text_key", "set_key").withColumn("at", F.monotonically_increasing_id())
    out = rows.join(own, "set_key", "left")
    # the class's first row: the smallest identifier, and of repeated rows the first in the staged table
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "at")
    heads = out.where("set_key is not null").groupBy("label").agg(F.min(order).alias("head")).select(F.col("label").alias("head_label"), "head.at")
    heads = heads.withColumnRenamed("at", "head_at")
    out = out.join(heads, (out["label"] == heads["head_label"]) & (out["at"] == heads["head_at"]), "left")
    alone = F.col("set_key").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | F.col("head_at").isNotNull()).alias("first"), "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns and one row of each class of ``jaccard_classes``."""
    classes = jaccard_classes(docs, id_col, text_col, **options)
    per = staged(classes.groupBy(F.col(id_col).alias("key_id"), F.col("text_key").alias("key_text")).agg(F.max("first").alias("stays"), F.count("*").alias("n")), "class-rows")
    gone = per.where(~F.col("stays"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"),
                       _text_key(F.col(f"`{text_col}`")).alias("own_text"))
    rows = rows.join(gone, rows["own_id"].eqNullSafe(gone["key_id"]) & (rows["own_text"] == gone["key_text"]), "left_anti")
    if not per.where(F.col("stays") & (F.col("n") > 1)).isEmpty():  # repeated rows: the same identifier and text
        rows = rows.dropDuplicates(["own_id", "own_text"])
    return rows.select("row.*")
