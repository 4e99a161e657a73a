"""Cases in which an operator once did less than its whole job."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_learned_and_packed import NASTY, SMALL, brute_classes, docs_of, nearest
from tokenizers import Tokenizer


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("hot", [500, 1490])
def test_search_beside_a_hot_cluster(spark, hot):
    """The smallest ids are one group of near copies; the other vectors, and lone ones opposite the group, get their k rows too."""
    from tidemark.llm.hash_search import search

    rng = np.random.default_rng(7)
    v = unit(rng.normal(size=(1500, 64)))
    v[:hot] = unit(v[0] + 0.02 * rng.normal(size=(hot, 64)))
    v[-4:] = unit(-v[0] + 0.02 * rng.normal(size=(4, 64)))
    rows = [(20 * i if i >= 1480 else 20 * i + 1 + i % 3, x.tolist()) for i, x in enumerate(v)]  # the last 20 are asked
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(set)
    for r in search(table, F.col("vec_id") % 20 == 0, k=20, block_rows=512).collect():
        got[r.query_id].add(r.vec_id)
    want = nearest(rows, 20)
    assert len(want) == 20 and got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert sum(len(got[q] & dict(w).keys()) for q, w in want.items()) / 400 >= 0.95
    assert min(len(got[q] & dict(w).keys()) for q, w in want.items()) >= 16


ADDED = [*NASTY, "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|> b", "don't<|endoftext|>'s", "é <|endoftext|> 中", "<|endof text|>"]


def default_ids(name, text):
    """The library's own call: the given file, nothing set."""
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_in_the_library(name):
    from tidemark.llm.bpe import Encoder

    ours = Encoder(public_tokenizers.path(name), added_tokens=True)
    want = [default_ids(name, t) for t in ADDED]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(ADDED)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(ADDED)] == want  # from the cache


def test_token_queries_give_the_library_ids(spark, tmp_path):
    import corpus_pipeline as cp

    from tidemark.llm.queries import QUERIES

    docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(ADDED)]).write.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got, at = {r.doc_id: r for r in QUERIES["op7_wavelet_files"](spark, str(tmp_path)).collect()}, 0
    for i, t in enumerate(ADDED):
        ids = [*default_ids("word_bpe_49k.json", t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    want = {i: crc([*default_ids("byte_bpe_50k.json", t), 2]) for i, t in enumerate(ADDED)}
    assert {r.doc_id: r.ids_crc32 for r in QUERIES["op9_sum_of_squares"](spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.ids_crc32 for r in cp.packed(spark, docs, str(tmp_path)).collect()} == want


SHORT = ["Avec.", "A.", "A.\nAll rights reserved.", "Osrañ.", "Bonjour!", "Re.", "Edrere.", "und", "is", "The cat", "été", "Sí.", "No", "Oui", "Ja!", "I", "of", "que", "der", "y"]


def test_pipeline_keeps_every_clean_document(spark, tmp_path):
    """run()'s pieces against brute force; only the mix is the stage's own, given the rows that must reach it."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    short = spark.createDataFrame([(10_000 + k, t, "en", "src1", len(t)) for k, t in enumerate(SHORT)] + [(10_500, "1234 5678", "en", "src1", 9)], docs.schema)
    docs.union(short).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert {r.doc_id for r in cp.language(spark, docs, "").collect()} == {r.doc_id for r in clean}
    first = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    left = {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in first.values()])}
    want = Counter()
    for r in cp.mix(spark, spark.createDataFrame([r for r in clean if r.doc_id in left], docs.schema), "").collect():
        ids = [*default_ids("byte_bpe_50k.json", r.text), 2]
        ends = [*range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want[r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = cp.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == want


def test_marks_alone_are_no_letters(spark):
    from tidemark.llm.language import Encoder, identify, prototypes

    learned = prototypes(docs_of(spark, [(k, "the cat sat with this other thing", "en", "s") for k in range(4)]), learn=F.lit(True))
    asked = [(0, "\u2764\ufe0f", "q", "q"), (1, "1\ufe0f\u20e3 2\ufe0f\u20e3", "q", "q"), (2, "\u0301", "q", "q"), (3, "e\u0301 \u2764\ufe0f", "q", "q")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs_of(spark, asked), learned).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"
    assert Encoder().grams("e\u0301")[0].tolist() != Encoder().grams("e")[0].tolist()  # a mark stays inside its n-grams
