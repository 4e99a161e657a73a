"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place. A text's vector bundles (adds) the vectors of all its n-grams, a language's prototype the
unit vectors of its learned texts, and a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
N = 3
UNKNOWN = "und"
#: Learned rows per language; a bound of the classifier's sample, never of what is predicted.
SAMPLE_ROWS = 2000
_TABLE_ROWS = 32_768
_CODE_BITS = 21


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _marks() -> np.ndarray:
    import unicodedata

    return np.array([unicodedata.category(chr(c)).startswith("M") for c in range(sys.maxunicode + 1)])


@dataclass
class Encoder:
    """Vectors of n-grams, kept for the worker's life in a table of bounded size."""

    seed: int = 11
    letter: np.ndarray = field(default_factory=_letters)
    mark: np.ndarray = field(default_factory=_marks)
    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    table: np.ndarray = field(default_factory=lambda: np.zeros((_TABLE_ROWS, DIMENSIONS), np.int8))

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams (as integers) and their counts; None if the text has no letter.

        Lower case; combining marks stay, every run of other characters is one blank, as are both ends.
        """
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = self.letter[codes]
        if not letter.any():
            return None
        codes = np.where(letter | self.mark[codes], codes, 0)
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        key = codes[: len(codes) - N + 1].copy()
        for k in range(1, N):
            key = key << _CODE_BITS | codes[k : len(codes) - N + 1 + k]
        return np.unique(key, return_counts=True)

    def _vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) > 4096:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.vectors[code] = bits * 2 - 1
        return self.vectors[code]

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), DIMENSIONS), np.int8)
        mask = (1 << _CODE_BITS) - 1
        for k in range(N):
            codes, at = np.unique(keys >> _CODE_BITS * (N - 1 - k) & mask, return_inverse=True)
            out *= np.stack([np.roll(self._vector(int(c)), N - 1 - k) for c in codes])[at]
        return out

    def learn_keys(self, keys: np.ndarray) -> None:
        """Puts new n-grams into the table while it has room."""
        new = np.setdiff1d(keys, self.keys)[: _TABLE_ROWS - len(self.keys)]
        if len(new):
            n = len(self.keys)
            self.table[n : n + len(new)] = self._bound(new)
            keys, place = np.append(self.keys, new), np.append(self.place, np.arange(n, n + len(new)))
            order = np.argsort(keys)
            self.keys, self.place = keys[order], place[order]

    def text_vector(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = counts[known].astype(np.float32) @ self.table[self.place[at[known]]].astype(np.float32)
        rest = keys[~known]
        for k in range(0, len(rest), 4096):  # beyond the table: the same vectors, made again
            out = out + counts[~known][k : k + 4096].astype(np.float32) @ self._bound(rest[k : k + 4096]).astype(np.float32)
        return out

    def counted_vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """Each text's vector and number of distinct n-grams."""
        found = [self.grams(t) for t in texts]
        some = [f[0] for f in found if f is not None]
        if some:
            self.learn_keys(np.unique(np.concatenate(some)))
        return [None if f is None else (self.text_vector(*f), len(f[0])) for f in found]

    def text_vectors(self, texts: list[str | None]) -> list[np.ndarray | None]:
        return [None if c is None else c[0] for c in self.counted_vectors(texts)]


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


_TEXTS = 512


def _parts(batch: pa.RecordBatch):
    return (batch.slice(at, _TEXTS) for at in range(0, batch.num_rows, _TEXTS))


def prototypes(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Unit prototype per language from rows for which ``learn`` holds and whose language is known.

    About ``sample_rows`` rows of each language, chosen by a hash of the identifier; a language with fewer rows is learned from all.
    Repeated rows share their draw and each counts.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & learn)
    known = known.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.count("*")).alias("share"))
    shares = {r[0]: r[1] for r in share.collect()}  # one number a language
    if not shares:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", F.lit("language-sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(draw < limit).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _parts(batch):
                for lang, v in zip(part.column(0).to_pylist(), encoder().text_vectors(part.column(1).to_pylist()), strict=True):
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v.astype(float) / np.linalg.norm(v) if v.any() else sums.get(lang, np.zeros(DIMENSIONS))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    every = rows.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "value"))
    # sums of rounded parts, so that the order in which partitions arrive does not matter
    total = every.groupBy("lang", "at").agg(F.sum(F.round(F.col("value") * 1e6).cast("long")).alias("value"))
    out: dict[str, np.ndarray] = {}
    for lang, values in sorted((r[0], r[1]) for r in total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value")))).collect()):
        v = np.array([x[1] for x in values], float)
        if v.any():
            out[lang] = v / np.linalg.norm(v)
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, grams_col: str | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus lang_pred, score and, if named, ``grams_col``: the text's number of distinct n-grams.

    score is the cosine with the chosen prototype, 0 where it is negative; equal cosines go to the first language by name. A null
    text, one without a letter, or any text where nothing was learned gets ``und`` and 0. Columns named like these are replaced. Every row
    is judged by itself, so repeated rows get equal results.
    """
    names = sorted(learned)
    matrix = np.stack([learned[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    columns = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", grams_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *([] if text_col in columns else [F.col(f"`{text_col}`").alias("text")]))

    def run(batches):
        langs, protos = shared.value
        for batch in batches:
            for part in _parts(batch):
                own = part.column(0)
                texts = part.column(1) if part.num_columns > 1 else own.field(text_col)
                langs_out, scores, grams = [], [], []
                for counted in encoder().counted_vectors(texts.to_pylist()):
                    v, n = counted or (None, 0)
                    grams.append(n)
                    if v is None or not len(langs):
                        langs_out.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    near = protos @ v / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(near.argmax())
                    langs_out.append(langs[best])
                    scores.append(float(min(1.0, max(0.0, near[best]))))
                yield pa.RecordBatch.from_arrays([own, pa.array(langs_out, pa.string()), pa.array(scores, pa.float64()), pa.array(grams, pa.int64())],
                                                 ["row", "lang_pred", "score", "grams"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("grams", T.LongType())])
    out = rows.mapInArrow(run, schema)
    return out.select("row.*", "lang_pred", "score", *([F.col("grams").alias(grams_col)] if grams_col else []))
