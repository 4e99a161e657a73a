"""Importance resampling, periodic runs and license scans: SQL statements, brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from oracle_check import compare, duckdb_conn

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
                     T.StructField("place", T.StringType()), T.StructField("words", T.StringType()), T.StructField("n_words", T.StringType()),
                     T.StructField("rank", T.StringType()), T.StructField("a.b", T.StringType())])
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op11_batch_concatenation", "op13_diagonal_voting"])
def test_matches_sql(spark, name):
    from tidemark.llm.oracle import ORACLE

    res = compare(spark, name, SF_DIR, ORACLE[name], duckdb_conn(SF_DIR))
    assert res["values_match"], res


# importance resampling

def plain_features(text, n):
    words = WORDS.findall((text or "").encode().lower())
    return [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, n_buckets, max_words, percent, least_words):
    bucket = lambda f: zlib.crc32(f) % n_buckets
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for _, text in docs:
        for f in plain_features(text, max_words):
            s[bucket(f)] += 1
    for text in target:
        for f in plain_features(text, max_words):
            t[bucket(f)] += 1
    out = []
    for i, text in docs:
        fs = plain_features(text, max_words)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + n_buckets) / ((s[b] + 1) * (t.sum() + n_buckets)))) for b in map(bucket, fs)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append((i, len(plain_features(text, 1)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    drawn = [(*r[:5], k + 1) for k, r in enumerate(fit[: len(fit) * percent // 100])]
    left = fit[len(fit) * percent // 100 :] + [r for r in out if r[1] < least_words]
    return drawn + [(*r, None) for r in left]


@pytest.mark.parametrize("max_words", [1, 3])
def test_resample_by_brute_force(spark, max_words):
    from tidemark.llm.importance import resample

    rnd = random.Random(3)
    vocabulary = ["Alpha", "beta", "naïve", "ÉTÉ", "漢字", "x1", "2nd", "end"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "-", "\x00", ". "]) for _ in range(n))
    rows = [(i, text(rnd.randrange(60))) for i in range(300)] + [(1000, "w " * 70_000), (1001, ""), (1002, None), (None, text(30)), (None, None)]
    rows += [(7, rows[7][1])] * 3 + [(1003, "!!! ---")]
    target = [text(40) for _ in range(20)] + [None, ""]
    got = resample(docs_of(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n_buckets=97, max_words=max_words, percent=25)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain_resample(rows, target, 97, max_words, 25, 20), key=key)


def test_features_do_not_cross_texts_or_portions(monkeypatch):
    from tidemark.llm import importance

    texts = [b"a b c", b"", b"d", b"e f A g", b"\x00 h\x00i"]
    want = sorted((k, zlib.crc32(f)) for k, t in enumerate(texts) for f in plain_features(t.decode(), 3))
    for portion in (1, 2, 3, 100):
        monkeypatch.setattr(importance, "BATCH_WORDS", portion)
        got = [(d, b) for _, ds, bs in importance.hashed_features(texts, 1 << 32, 3) for d, b in zip(ds.tolist(), bs.tolist(), strict=True)]
        assert sorted(got) == want


def test_resample_empty(spark):
    from tidemark.llm.importance import resample

    none = spark.createDataFrame([], DOCS)
    assert resample(none, none).count() == 0
    got = resample(docs_of(spark, [(1, "a " * 30)]), none, percent=100).collect()
    assert [(r.doc_id, r.rank) for r in got] == [(1, 1)]


# periodic runs

def plain_runs(words, min_length=6, min_exponent=4):
    """Stretches of every period, longest of each; a period counts only if no smaller one has the same stretch inside its own."""
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q):
                smaller = any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q))
                if not smaller:
                    found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs))


def test_runs_by_brute_force(spark):
    from tidemark.llm.periodic import periodic_runs

    rnd = random.Random(5)
    texts = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "b " * 50, "ab ab ab ab c " * 9, "x y " * 4 + "z", "é é " * 8]
    for _ in range(150):
        words = []
        while len(words) < rnd.randrange(5, 80):
            unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))]
            words += unit * rnd.randrange(1, 8) + unit[: rnd.randrange(len(unit) + 1)]
        texts.append(rnd.choice([" ", "\n", " \t"]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q q q q q q q"), (3, "a")]
    for least, exponent in ((6, 4), (2, 2), (5, 3)):
        got = {}
        for r in periodic_runs(docs_of(spark, rows), min_length=least, min_exponent=exponent).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
        want = {}
        for i, t in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            runs = plain_runs(words, least, exponent)
            want.setdefault(i, []).append((len(words), runs, plain_collapse(words, runs)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_runs_of_long_texts(spark):
    from tidemark.llm.periodic import periodic_runs

    rnd = random.Random(1)
    unit = [str(rnd.randrange(1000)) for _ in range(9_999)]
    rows = [(1, "a " * 200_000), (2, " ".join(unit * 5)), (3, " ".join(str(rnd.randrange(50)) for _ in range(100_000)))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs_of(spark, rows)).collect()}
    assert got[1] == [(0, 200_000, 1)]
    assert (0, 49_995, 9_999) in got[2] and len(got[2]) == 1
    assert got[3] == []
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_large_sets_merge_like_small_ones(monkeypatch):
    from tidemark.llm import periodic

    rnd = random.Random(2)
    words = [[rnd.choice([b"a", b"b"]) for _ in range(3000)], [b"c"] * 500]
    results = []
    for size in (0, 64, 10**9):
        monkeypatch.setattr(periodic, "SMALL_SET", size)
        results.append(sorted(periodic.runs_of(*periodic._codes(words), 2, 2)))
    assert results[0] == results[1] == results[2]
    assert [r for r in results[0] if r[0] < 3000] == sorted(plain_runs([w.decode() for w in words[0]], 2, 2))


def test_op12_digests_by_brute_force(spark):
    from tidemark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_descending_lcp"](spark, SF_DIR).collect()}
    n_runs = 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 2000 else None
        if runs is None:
            continue
        out = got[r.doc_id]
        n_runs += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (out.n_runs, out.start, out.length, out.period) == (len(runs), *best)
        assert out.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert out.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert out.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert n_runs > 10


# license scans

def test_licenses_by_brute_force(spark):
    from tidemark.llm.license_scan import NOTICES, PHRASES, scan_licenses

    rnd = random.Random(9)
    notice = WORDS.findall(NOTICES[0][1].encode().lower())
    lost = [w for k, w in enumerate(notice) if k not in (5, 20)]
    texts = ["MIT License, mit-license. MIT\nLICENSE!", "the GNU General Public License", "gnu general public", None, "", "cc", "CC BY 4.0 cc by", "KMIT license"]
    texts += ["so: " + NOTICES[0][1] + " end", b" ".join(lost).decode(), b" ".join(notice[:20]).decode(), "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0."]
    texts += [" ".join(rnd.choice(["mit", "license", "cc", "by", "gnu", "general", "public", "apache", "é"]) for _ in range(200)) for _ in range(20)]
    texts += ["cc by " * 30_000, "of the software and this license " * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (0, texts[0]), (0, texts[0])]
    got = scan_licenses(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        words = [w.decode() for w in WORDS.findall((t or "").encode().lower())]
        places = [(k, label) for label, phrase in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in places}))))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    by = {r.doc_id: r for r in got}
    labels = lambda t: by[texts.index(t)].labels
    assert labels(texts[8]) == "mit" and by[8].score == 1.0
    assert labels(texts[9]) == "mit" and 0.8 <= by[9].score < 1 and by[9].base_labels == ""
    assert labels(texts[10]) == "" and by[10].score == 0
    assert labels("Licensed under CC BY 4.0.") == "cc-by" and labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc"
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
