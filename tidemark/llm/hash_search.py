"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after rotations that are learned on a bounded sample (each step takes the signs, then the
rotation that brings the sample nearest to them). Codes are cut into substrings and every block of the index keeps, for each substring, the
values that occur and who has them. By the pigeonhole principle a code within the radius of a query's agrees with it in some substring to within
that substring's share of the radius; probing all values that near finds every such code. Codes within the radius are
reranked by the inner product of the original vectors in double precision. The first radius comes from the sample; a query that finds
fewer than k, or whose k-th neighbour's angle says that its radius is too small, is probed again at a larger one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runs import groups
from tidemark.llm.staging import staged

BITS = 256
SUBSTRING_BITS = 16
#: Vectors on which rotations and radius are fitted at most; every vector is indexed.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
#: Share of true neighbours that a radius must reach: of the sample's, and of those at the angle of a query's k-th.
COVERED = 0.98
#: A query with fewer than k neighbours is probed again with so many bits more, up to all.
WIDER_BITS = BITS // 4
BLOCK_ROWS = 8192
_STEPS = 25


@dataclass
class Codes:
    """What makes a vector's code: the largest norm, and rotations side by side."""

    norm: float
    rotation: np.ndarray
    radius: int = 0

    def encode(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Rows of 64-bit words. One more component gives stored vectors one norm, so the inner product orders like the angle."""
        squares = np.zeros(len(vectors)) if query else np.maximum(self.norm**2 - (vectors * vectors).sum(axis=1), 0)
        longer = np.concatenate((vectors, np.sqrt(squares)[:, None]), axis=1)
        return np.packbits(longer @ self.rotation > 0, axis=1, bitorder="little").view("<u8")

    def needed(self, queries: np.ndarray, scores: np.ndarray, covered: float = COVERED) -> np.ndarray:
        """Radius within which a code lies with probability ``covered`` if its vector has the score: each bit differs with odds angle / pi."""
        bits = self.rotation.shape[1]
        cosine = scores / np.maximum(self.norm * np.sqrt((queries * queries).sum(axis=1)), np.finfo(float).tiny)
        share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        reach = bits * share + NormalDist().inv_cdf(covered) * np.sqrt(bits * share * (1 - share))
        return np.minimum(np.ceil(reach), bits).astype(np.int64)


def _learn_rotation(sample: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    if len(sample):
        for _ in range(_STEPS):
            signs = np.where(sample @ rotation > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ sample)
            rotation = (u @ vt).T
    return rotation


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, norm: float, k: int, bits: int = BITS, covered: float = COVERED, seed: int = 5) -> Codes:
    """Rotations and radius from a sample (rows of doubles); the same rows give the same codes."""
    rng = np.random.default_rng(seed)
    longer = np.concatenate((sample, np.sqrt(np.maximum(norm**2 - (sample * sample).sum(axis=1), 0))[:, None]), axis=1)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        parts.append(_learn_rotation(longer, rng))
    codes = Codes(norm, np.concatenate(parts, axis=1)[:, :bits])
    drawn = np.sort(np.random.default_rng([seed, len(sample)]).permutation(len(sample))[:SAMPLE_QUERIES])
    stored, asked = codes.encode(sample, query=False), codes.encode(sample[drawn], query=True)
    far: list[np.ndarray] = []
    last = np.zeros(len(drawn))
    for at, i in enumerate(drawn.tolist()):
        near = sample @ sample[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(sample) - 1)]
        far.append(distances(stored[best], asked[at]))
        last[at] = near[best[-1]] if len(best) else 0.0
    # a sample this small says nothing about the radius: then every code is within it
    if len(sample) > 4 * k:
        radius = max(np.quantile(np.concatenate(far), covered), np.quantile(codes.needed(sample[drawn], last, covered), covered))
        codes.radius = int(np.ceil(radius))
    else:
        codes.radius = bits
    return codes


class BlockIndex:
    """One block's codes by substring value."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.parts = codes.view("<u2")
        self.index = []
        for j in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, j], kind="stable")
            values, first = np.unique(self.parts[order, j], return_index=True)
            self.index.append((values, np.append(first, len(order)), order))

    def within(self, query: np.ndarray, radius: int | None = None) -> np.ndarray:
        """Rows whose code is within the radius (the index's, if none is given) of the query's: all of them, and no others."""
        radius = self.radius if radius is None else radius
        # pigeonhole: radius = m * most + rest; rest + 1 substrings must be probed to most, the others to most - 1
        most, rest = divmod(radius, len(self.index))
        seen = np.zeros(len(self.codes), bool)
        for j, ((values, first, order), part) in enumerate(zip(self.index, query.view("<u2"), strict=True)):
            share = most if j <= rest else most - 1
            if share < 0:
                continue
            hit = np.bitwise_count(values ^ part) <= share
            seen[order[np.repeat(hit, np.diff(first))]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.codes[rows], query) <= radius]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null, NaN or infinite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` rows nearest to each row for which ``asked`` holds: query_id, rank (from 1), ``id_col``, score.

    Nearness is the inner product in double precision, ties go to the smaller identifier. Rows with a query's identifier are not its
    neighbours. Vectors that are null, zero or hold a null, NaN or infinite component take no part, nor do null
    identifiers and vectors of another length than most (of equally common lengths, the largest counts). Equal vectors are collapsed
    first: beyond the k + 1 smallest identifiers of one vector none can be among any query's nearest. A query row that occurs twice is
    answered once. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), asked.alias("asked"))
    rows = staged(rows.where(F.col("id").isNotNull() & usable(F.col("vector"))), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "size"))["size"].alias("size")).first()
    none = spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    if sizes is None or sizes[0] is None:
        return none
    rows = rows.where(F.size("vector") == sizes[0])
    same = Window.partitionBy("vector").orderBy("id")
    stored = rows.select("id", "vector").withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1).drop("at")
    stored = staged(stored, "distinct-vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, norm = stored.agg(F.count("*"), F.max(F.sqrt(squares))).first()
    chance = min(1.0, sample_rows / n)
    drawn = F.pmod(F.xxhash64("id", F.lit("vector-sample")), F.lit(1 << 30)) < int(chance * (1 << 30))
    sample = stored.where(drawn).select("id", "vector").toArrow().sort_by("id")
    codes = fit(_matrix(sample["vector"]) if len(sample) else np.zeros((0, sizes[0])), norm, k)

    n_blocks = -(-n // block_rows)
    index = stored.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("key"), "vector", F.lit(0).cast("long").alias("radius"))
    shared = spark.sparkContext.broadcast(codes)

    def run(batches):
        code = shared.value
        block, own = None, None
        for table in groups(batches, ["block", "kind"]):
            found = _matrix(table["vector"])
            ids = table["id"].to_numpy()
            if table["kind"][0].as_py() == 0:
                block, own = table["block"][0].as_py(), (ids, found, BlockIndex(code.encode(found, query=False), code.radius))
                continue
            if block != table["block"][0].as_py():
                continue  # no stored vector in this block
            best_ids, best_scores = [], []
            radii = table["radius"].to_pylist()
            for one, vector, query, radius in zip(ids.tolist(), found, code.encode(found, query=True), radii, strict=True):
                at = own[2].within(query, radius)
                at = at[own[0][at] != one]
                scores = (own[1][at] * vector).sum(axis=1)
                order = np.lexsort((own[0][at], -scores))[:k]
                best_ids.append(own[0][at][order])
                best_scores.append(scores[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), table["key"].combine_chunks(), pa.array(best_ids, pa.list_(pa.int64())), pa.array(best_scores, pa.list_(pa.float64()))],
                ["query_id", "query_key", "ids", "scores"])

    def probe(queries: DataFrame) -> DataFrame:
        dealt = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).withColumn("kind", F.lit(1))
        both = index.unionByName(dealt).repartition("block").sortWithinPartitions("block", "kind", "id")
        near = both.mapInArrow(run, "query_id bigint, query_key bigint, ids array<bigint>, scores array<double>")
        near = near.select("query_id", "query_key", F.explode(F.arrays_zip("ids", "scores")).alias("near"))
        order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("near.scores"), "near.ids")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def widen(batches):
        code = shared.value
        for batch in batches:
            radius, n_found = batch.column("radius").to_numpy(), batch.column("n_found").to_numpy()
            wider = np.where(n_found < k, radius + WIDER_BITS, code.needed(_matrix(batch.column("vector")), batch.column("least").to_numpy()))
            wider = np.minimum(wider, BITS)
            batch = batch.set_column(batch.schema.get_field_index("radius"), "radius", pa.array(wider))
            yield batch.filter(pa.array(wider > radius)).select(["id", "key", "vector", "radius"])

    queries = rows.where("asked").select("id", "vector").distinct()
    queries = staged(queries.select("id", F.xxhash64("vector").alias("key"), "vector", F.lit(codes.radius).cast("long").alias("radius")), "queries")
    finished: list[DataFrame] = []
    while True:  # radii only grow, and end at all bits
        near = staged(probe(queries), "near")
        found = near.groupBy(F.col("query_id").alias("id"), F.col("query_key").alias("key")).agg(F.count("*").alias("n_found"), F.min("near.scores").alias("least"))
        reached = queries.join(found, ["id", "key"], "left").na.fill(0, ["n_found"]).na.fill(0.0, ["least"])
        open_queries = staged(reached.mapInArrow(widen, queries.schema), "open-queries")
        if open_queries.isEmpty():
            finished.append(near)
            break
        again = open_queries.select(F.col("id").alias("query_id"), F.col("key").alias("query_key"))
        finished.append(near.join(again, ["query_id", "query_key"], "left_anti").select(near.columns))
        queries = open_queries
    near = reduce(DataFrame.unionByName, finished)
    return near.select("query_id", "rank", F.col("near.ids").alias(id_col), F.col("near.scores").alias("score"))
