"""Runs: maximal stretches of words that repeat with a period, found by uniting suffix classes in descending LCP order.

Inside a document, suffixes that share their first L words form a class. Classes are united by decreasing L (Kruskal's order over
neighbours in the suffix order, union-find over ordered position sets). When two positions become neighbours in their class at a
distance of at most L, the words there repeat with that distance; the distance is the smallest period, since a smaller one
would have put a position between them before. L is the exact common length, so the stretch ends there, and it is a run's start if
the words before the two positions differ. Every run with at least two periods is met exactly once.

The suffix order comes from prefix doubling in numpy over many documents at a time, refining only classes that still hold
several positions; in prose few windows of four words repeat, so little is left after two steps.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.importance import byte_batches

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Text that a task handles at a time; a longer text stands alone.
BATCH_BYTES = 1 << 21
#: Sets beyond this size are merged as a whole instead of element by element.
SMALL_SET = 64


def _least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest L for which a distance d of 1 or more can give length L + d >= max(min_length, min_exponent * d)."""
    return min(max((min_exponent - 1) * d, min_length - d) for d in range(1, max(2, min_length)))


def _codes(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes in a row, no code in two documents, and each position's document end."""
    codes: list[int] = []
    ends, base = [], 0
    for words in documents:
        own: dict[bytes, int] = {}
        codes += [base + own.setdefault(w, len(own)) for w in words]
        base += len(own)
        ends.append(len(codes))
    return np.array(codes, np.int64), np.repeat(ends, [len(w) for w in documents]).astype(np.int64)


def _sorted_classes(codes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``window`` words (a power of two) occur twice in their document, in suffix order, and a class number each."""
    n = len(codes)
    size = np.bincount(codes)
    rank = (np.cumsum(size) - size)[codes]  # a class's rank is the place of its first member
    active = np.argsort(rank, kind="stable")
    active = active[size[codes[active]] > 1]
    kept, classes = (active, rank[active]) if window == 1 else (None, None)
    h = 1
    while len(active):
        after = active + h
        inside = after < ends[active]
        key = rank[active] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        place = np.arange(len(active))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old_start = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), place, 0))
        new_start = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = old + new_start - old_start
        members = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(members, members) > 1]
        h *= 2
        if h == window:
            kept, classes = active, rank[active].copy()
    if kept is None:
        return active, active
    order = np.argsort(rank[kept], kind="stable")
    return kept[order], classes[order]


def _common_lengths(codes: list[int], ends: list[int], kept: np.ndarray, classes: np.ndarray, window: int) -> tuple[list[int], list[int], list[int]]:
    """(left, right, L) of neighbours in suffix order of one class; L is exact."""
    before = np.full(len(codes), -1, np.int64)
    same = classes[1:] == classes[:-1]
    before[kept[1:][same]] = kept[:-1][same]
    lefts, rights, lengths = [], [], []
    last, known = -2, window
    for i in np.flatnonzero(before >= 0).tolist():
        j = int(before[i])
        known = max(known - 1, window) if i == last + 1 else window
        room = ends[i] - max(i, j)  # both in one document
        while known < room and codes[i + known] == codes[j + known]:
            known += 1
        last = i
        lefts.append(j)
        rights.append(i)
        lengths.append(known)
    return lefts, rights, lengths


def _new_neighbours(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The united ordered set and the pairs of neighbours of which one comes from each set."""
    if len(small) > SMALL_SET:
        merged = np.array(sorted(large + small), np.int64)
        mine = np.isin(merged, np.array(small, np.int64), assume_unique=True)
        turns = np.flatnonzero(mine[1:] != mine[:-1])
        return merged.tolist(), list(zip(merged[turns].tolist(), merged[turns + 1].tolist(), strict=True))
    pairs = []
    own = set(small)
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and large[at - 1] not in own:
            pairs.append((large[at - 1], x))
        if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
            pairs.append((x, large[at]))
        large.insert(at, x)
    return large, pairs


def runs_of(codes: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by position in ``codes``."""
    least = _least_lcp(min_length, min_exponent)
    window = 1 << (least.bit_length() - 1)
    kept, classes = _sorted_classes(codes, ends, window)
    if not len(kept):
        return []
    code = codes.tolist()
    lefts, rights, lengths = _common_lengths(code, ends.tolist(), kept, classes, window)
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    found = []
    for k in np.argsort(-np.array(lengths, np.int64), kind="stable").tolist():
        common = lengths[k]
        if common < least:
            break
        a, b = find(lefts[k]), find(rights[k])
        left, right = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(left) < len(right):
            a, b, left, right = b, a, right, left
        root[b] = a
        members[a], pairs = _new_neighbours(left, right)
        for i, j in pairs:
            d = j - i
            if common + d >= min_length and common >= (min_exponent - 1) * d and (i == 0 or code[i - 1] != code[j - 1]):
                found.append((i, common + d, d))
    return found


def _kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that lie in a run after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def _documents(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    documents = [t.split() for t in texts]  # bytes: the six ASCII white-space characters only
    firsts = np.concatenate(([0], np.cumsum([len(w) for w in documents])))
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if firsts[-1]:
        for start, length, period in runs_of(*_codes(documents), min_length, min_exponent):
            d = int(np.searchsorted(firsts, start, side="right")) - 1
            found[d].append((start - int(firsts[d]), length, period))
    for words, runs in zip(documents, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        yield len(words), runs, b" ".join(_kept_words(words, runs)).decode("utf-8")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, runs (array of start, length, period by start, then period) and collapsed.

    Words are split at ASCII white space and numbered from 0. A run is a longest stretch with smallest period q and at least
    max(min_length, min_exponent * q) words; ``min_exponent`` is 2 or more. ``collapsed`` is the text's words, joined by one blank, without
    those that a run holds after its first q words. Null and empty texts give no word, no run and an empty text. Null identifiers and
    repeated rows give their own rows; an empty table gives none. Other columns are ignored. No row needs another, so nothing is
    shuffled; a task's memory is bounded by its longest text.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def task(batches):
        for batch in batches:
            for first, texts in byte_batches(batch.column(1), BATCH_BYTES):
                out = list(_documents(texts, min_length, min_exponent))
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([n for n, _, _ in out], pa.int64()), pa.array(runs, arrow_runs),
                     pa.array([t for _, _, t in out], pa.string())], [id_col, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
                           T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(task, schema)
