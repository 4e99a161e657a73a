"""Toxicity by a factorization machine over hashed terms.

    score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

x_i says whether one of a text's words hashes to term i. The pairwise part lets a pair of terms count more (or less) than the
terms alone, which additive weights cannot. The model is fitted on the driver from a bounded sample of labelled rows and is
a fixed number of floats; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.staging import staged

TERM_BITS = 18
FACTORS = 8
#: Labelled rows that the fit reads at most; a bound of the classifier's sample, never of what is scored.
SAMPLE_ROWS = 20_000
#: Terms with the strongest link to the label (chi-square) that get weights.
SELECTED = 4096
_MIN_ROWS = 3
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> np.ndarray:
    """The text's distinct words as sorted distinct hashed terms; words are runs of letters, in lower case."""
    if not text:
        return np.zeros(0, np.int64)
    words = set(_WORD.findall(" ".join(set(text.lower().split()))))
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) & ((1 << TERM_BITS) - 1))


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # a term's row in the weights, -1: none
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = self.slot[found]
        at = at[at >= 0]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _strongest(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """Terms by chi-square with the label, strongest first, ties by term."""
    seen = np.bincount(cols, minlength=n_terms).astype(float)
    both = np.bincount(cols, weights=y[rows], minlength=n_terms)
    n, pos = len(y), y.sum()
    expected = seen * pos / n
    spread = expected * (1 - pos / n) * np.maximum(1 - seen / n, 1e-9)
    chi = np.where((seen >= _MIN_ROWS) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    order = np.lexsort((np.arange(n_terms), -chi))[:SELECTED]
    return np.sort(order[chi[order] > 0])


def fit(found: list[np.ndarray], labels: np.ndarray, epochs: int = 150, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adam on the mean log loss of the whole sample; the same rows give the same machine. Without rows the score is one half, with
    labels of one kind their smoothed share."""
    y = np.asarray(labels, float)
    slot = np.full(1 << TERM_BITS, -1, np.int32)
    if not len(y):
        return Machine(0.0, slot, np.zeros(0), np.zeros((0, FACTORS)))
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.concatenate(found) if found else np.zeros(0, np.int64)
    chosen = _strongest(rows, cols, y, 1 << TERM_BITS)
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    share = (y.sum() + 1) / (len(y) + 2)
    keep = slot[cols] >= 0
    rows, cols = rows[keep], slot[cols[keep]].astype(np.int64)
    n, m = len(y), len(chosen)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(m), np.random.default_rng(seed).normal(0, 0.02, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, weights=values[:, k], minlength=size) for k in range(values.shape[1])], axis=1)

    for step in range(1, epochs + 1):
        bias, w, v = params
        own = v[cols]
        total = by(rows, own, n)
        pairs = 0.5 * ((total**2).sum(axis=1) - np.bincount(rows, weights=(own**2).sum(axis=1), minlength=n))
        z = bias[0] + np.bincount(rows, weights=w[cols], minlength=n) + pairs
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = miss[rows]
        grads = [np.array([miss.sum()]), np.bincount(cols, weights=slope, minlength=m) + decay * w / max(m, 1),
                 by(cols, slope[:, None] * (total[rows] - own), m) + decay * v / max(m, 1)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), slot, params[1], params[2])


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (text, label) as (terms, label)."""

    def run(batches):
        for batch in batches:
            found = [terms(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], ["terms", "label"])

    return rows.mapInArrow(run, "terms array<bigint>, label double")


def _within(hashed: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``hashed`` with only the terms among ``chosen``."""

    among = np.zeros(1 << TERM_BITS, bool)
    among[chosen] = True

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            found = [np.asarray(lists[i].values, np.int64) for i in range(len(lists))]
            kept = [t[among[t]] for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int64())), batch.column(1)], ["terms", "label"])

    return hashed.mapInArrow(run, "terms array<bigint>, label double")


def selected_terms(hashed: DataFrame) -> DataFrame:
    """The ``SELECTED`` terms of ``hashed`` (terms, label) with the strongest link to the label, counted by Spark: a column term.

    The rule is that of the fit; without labels of both kinds there are none.
    """
    whole = hashed.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("pos"))
    per = hashed.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(
        F.count(F.lit(1)).cast("double").alias("seen"), F.sum("label").alias("both")).where(F.col("seen") >= _MIN_ROWS)
    n, pos = whole.select("n").scalar(), whole.select("pos").scalar()
    per = per.withColumn("expected", F.col("seen") * pos / n)
    per = per.withColumn("spread", F.col("expected") * (1 - pos / n) * F.greatest(1 - F.col("seen") / n, F.lit(1e-9)))
    miss = F.col("both") - F.col("expected")
    per = per.where("spread > 0").withColumn("chi", miss * miss / F.greatest(F.col("spread"), F.lit(1e-9)))
    return per.where("chi > 0").orderBy(F.col("chi").desc(), "term").limit(SELECTED).select("term")


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from the labelled rows for which ``learn`` holds, at most ``sample_rows`` of them by a hash of the identifier.

    Null labels and labels of unknown documents are left out; a document with several labels counts with each; so do
    repeated rows of a document. The terms are counted in Spark; the driver gets the selected terms and, of each sampled
    row, which of these it holds, however long its text is.
    """
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & learn).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
    n = known.count()
    chance = min(1.0, sample_rows / n) if n else 1.0
    if chance < 1:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("toxic-sample")), F.lit(1 << 30)) < int(chance * (1 << 30)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(known, "id")
    hashed = staged(_hashed(rows.select("text", "label")), "toxic-terms")
    chosen = np.sort(np.array([r[0] for r in selected_terms(hashed).collect()], np.int64))
    table = _within(hashed, chosen).toArrow()
    found = [np.asarray(t, np.int64) for t in table["terms"].to_pylist()]
    y = table["label"].to_numpy()
    order = sorted(range(len(y)), key=lambda i: (y[i], found[i].tobytes()))  # arrival order must not matter
    return fit([found[i] for i in order], y[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, score, predicted; other columns are left out, whatever their names, and an empty table gives
    an empty result. A null or empty text has no terms and gets the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.score(terms(t)) for t in batch.column(1).to_pylist()]
            kept = pa.array([int(s >= 0.5) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), kept], ["id", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "score", "predicted")
