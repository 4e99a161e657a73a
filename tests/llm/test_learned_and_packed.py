"""Toxicity, language, search, token files, packing and the pipeline: held-out accuracy, round trips and brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, score string"
NASTY = ["don't ''s  x\n\n y\t z   q 12²4 'real '' 'S I'LL", "  lead", "trail  ", "中文 é İ ẞ", "\x85a\x1cb", "", " ", "\n", "a\r\n b", "<|endoftext|> x </w>",
         "x\x00y", "é combining", "😀 smile", "'tis 'Twas", "...,,,;; a.b", "a\xa0 b", "½²ªº"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "a", "b", "c") for i, t, lang, s in rows], DOCS).repartition(3)


def library_ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(spark, name):
    from tidemark.llm.bpe import Encoder

    texts = NASTY + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()][:200]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    ours = Encoder(public_tokenizers.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode(texts) == want
    assert ours.encode(texts) == want  # from the cache


def test_wavelet_matrix_answers():
    from tidemark.llm.wavelet import Shard, build

    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (511, 5), (512, 50_000), (5000, 300), (3000, 2)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        starts = np.array([0, n // 3, n])
        shard = Shard(build(ids, np.array([4, 9]), starts, nulls=1))
        assert (shard.all_ids() == ids).all() and shard.starts.tolist() == starts.tolist()
        assert shard.doc_ids.tolist() == [4, 9] and shard.null_docs.tolist() == [False, True]
        if n:
            at = rng.integers(0, n, 50)
            assert (shard.access(at) == ids[at]).all()
            for token in [*ids[:5].tolist(), 0, top + 100_000]:
                a, b = n // 4, n - n // 5
                assert shard.count(token) == int((ids == token).sum()) and shard.count(token, a, b) == int((ids[a:b] == token).sum())
                assert shard.occurrences(token)[:40] == np.flatnonzero(ids == token).tolist()[:40]
    with pytest.raises(ValueError):
        Shard(b"not one")


def test_token_files_round_trip(spark, tmp_path):
    from tidemark.llm.token_files import read_token_files, write_token_files

    rows = [(i * 7 % 101, f"doc number {i} has words", "en", "s") for i in range(60)] + [(None, "no id", None, None), (500, None, None, None), (3, "twice", "x", "x"), (3, "twice", "x", "x")]
    rows += [(600 + i, t, "en", "s") for i, t in enumerate(NASTY)] + [(700, "very long text " * 20_000, "en", "s")]
    folder = str(tmp_path / "t")
    index = write_token_files(docs_of(spark, rows), folder, public_tokenizers.path("word_bpe_49k.json"), shard_ids=100)
    got = [(r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, folder, index).collect()]
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ids = [*library_ids("word_bpe_49k.json", t), 2]
        want.append((i, at, ids))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert index.count() > 5
    none = write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "e"), public_tokenizers.path("word_bpe_49k.json"))
    assert read_token_files(spark, str(tmp_path / "e"), none).count() == 0


def check_packing(rows, lengths, limit):
    """rows: (sequence_id, offset, length)."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    assert sorted(n for *_, n in rows) == sorted(lengths)
    return len(by)


def best_fit_decreasing(lengths, limit):
    gaps, bins = Counter(), 0
    for n in sorted(lengths, reverse=True):
        fit = min((g for g, c in gaps.items() if c and g >= n), default=None)
        if fit is None:
            bins, fit = bins + 1, limit
        else:
            gaps[fit] -= 1
        gaps[fit - n] += 1
    return bins


def test_packing_is_gapless_and_tight(spark):
    from tidemark.llm.packing import pack

    rng = np.random.default_rng(1)
    lengths = [*rng.integers(1, 1025, 3000).tolist(), 1024, 1024, 1, 1]
    pieces = spark.createDataFrame([(None if k % 50 == 0 else k, n, "x") for k, n in enumerate(lengths)], "doc_id long, length long, row string").repartition(4)
    for group in (16_384, 500):
        rows = [(r.sequence_id, r.offset, r.length) for r in pack(pieces, group_pieces=group).collect()]
        n = check_packing(rows, lengths, 1024)
        assert n <= best_fit_decreasing(lengths, 1024) * (1.002 if group > len(lengths) else 1.02) + 1
    assert pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_sum_of_squares_rule_on_a_small_case():
    from tidemark.llm.packing import _Bins

    bins = _Bins(10)
    for gap, many in ((7, 2), (5, 1), (4, 1)):
        for _ in range(many):
            bins.open[gap].append(bins.made)
            bins.made += 1
        bins.counts[gap] = many
    def squares(gap):
        c = bins.counts.copy()
        c[gap] -= 1
        if gap > 2:
            c[gap - 2] += 1
        return int((c[1:10] ** 2).sum())
    best = min((g for g in (7, 5, 4)), key=lambda g: (squares(g), g))
    assert bins.place(2)[1] == 10 - best


def test_packed_pieces_hold_the_library_ids(spark):
    from tidemark.llm.packing import token_pieces

    rows = [(i, t, "en", "s") for i, t in enumerate(NASTY)] + [(90, None, None, None), (None, "x", None, None), (91, "many words here " * 3000, "en", "s"), (92, "dup", "a", "b"), (92, "dup", "a", "b")]
    got = defaultdict(list)
    for r in token_pieces(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t, *_ in rows:
        ids = [*library_ids("byte_bpe_50k.json", t or ""), 2]
        own = sorted(got[i])
        if i == 92:
            own = own[::2]
        assert [x for _, _, _, part in own for x in part] == ids
        assert all(s == sum(len(p[3]) for p in own[:k]) and n == len(part) for k, s, n, part in own)
        assert all(n == 1024 for _, _, n, _ in own[1:]) and 1 <= own[0][2] <= 1024


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = (y == 1).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_toxicity_on_held_out_rows(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    out = QUERIES["op4_factorization_machine"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert area(s, y) > 0.97
    assert ((s >= 0) & (s <= 1)).all() and all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_factorization_machine_learns_a_pair():
    """Neither word alone says anything; together they do (an insult with a group mention)."""
    from tidemark.llm.toxicity import fit, terms

    rng = np.random.default_rng(0)
    texts, y = [], []
    for k in range(1200):
        a, b = k & 1, k >> 1 & 1
        words = [f"w{rng.integers(40)}x" for _ in range(6)] + ["dirty"] * a + ["immigrants"] * b
        texts.append(" ".join(words))
        y.append(a & b)
    model = fit([terms(t) for t in texts], np.array(y))
    assert model.score(terms("dirty immigrants")) > 0.5 > max(model.score(terms("dirty dishes")), model.score(terms("immigrants welcome")))


def test_toxicity_edges(spark):
    from tidemark.llm.toxicity import score, train

    docs = docs_of(spark, [(1, "you idiot", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "fine words", "en", "s"), (4, "ok " * 100_000, "en", "s"), (4, "ok", "en", "s")])
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (77, 1), (None, 1)], "doc_id long, toxic int")
    got = score(docs, train(docs, labels, learn=F.lit(True))).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = train(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int"), learn=F.lit(True))
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(spark.createDataFrame([], DOCS), empty).count() == 0


def test_language_on_held_out_rows(spark):
    from tidemark.llm.queries import QUERIES

    rows = QUERIES["op8_hyperdimensional"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edges_and_whole_texts(spark):
    from tidemark.llm.language import identify, prototypes

    en, de = "the cat sat with this other thing that they thought ", "und die katze sitzt nicht auf dem großen tisch schön "
    rows = [(k, (en if k % 2 else de) * (1 + k % 3), "en" if k % 2 else "de", "s") for k in range(20)]
    learned = prototypes(docs_of(spark, rows + [(50, "x", None, None)]), learn=F.lit(True))
    assert sorted(learned) == ["de", "en"]
    asked = [(1, None, "q", "q"), (2, "", "q", "q"), (3, "123 !!! \n", "q", "q"), (4, "they thought that", "q", "q"), (None, "NICHT AUF DEM TISCH", None, None),
             (6, "中文字 ру́сский", "q", "q"), (7, "the " * 5 + "und die katze sitzt nicht " * 20_000, "q", "q")]
    out = identify(docs_of(spark, asked), learned)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[None][0] == "de" and got[7][0] == "de" and got[6][0] in learned
    assert {r.lang_pred for r in identify(docs_of(spark, asked), {}).collect()} == {"und"}
    assert prototypes(spark.createDataFrame([], DOCS), learn=F.lit(True)) == {}
    assert identify(spark.createDataFrame([], DOCS), learned).count() == 0


def test_language_vectors_are_the_bound_letters():
    from tidemark.llm.language import Encoder

    e = Encoder()
    v = e.text_vectors(["Ab"])[0]
    a, b, blank = e._vector(ord("a")).astype(int), e._vector(ord("b")).astype(int), e._vector(0).astype(int)
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert (v == want).all()


def nearest(rows, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max(Counter(len(v) for _, v in fine).items(), key=lambda c: (c[1], c[0]))[0] if fine else 0
    fine = [(i, v) for i, v in fine if len(v) == size]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine], float)
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = (x * x[n]).sum(axis=1)
        order = [m for m in np.lexsort((ids, -s)) if ids[m] != ids[n]][:k]
        out[int(ids[n])] = [(int(ids[m]), float(s[m])) for m in order]
    return out


def test_search_recall_and_scores(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = nearest(rows, 20), defaultdict(list)
    for r in QUERIES["op5_multi_index_hashing"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) / (20 * len(want)) >= 0.9
    x = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - float(np.dot(np.array(x[q], float), np.array(x[i], float)))) < 1e-12 for i, s in found)


def test_search_edges(spark):
    from tidemark.llm.hash_search import search

    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 61)] + [(100 + i, [1.0] * 8) for i in range(40)] + [(20, [0.0, 1.0] * 4), (20, [0.0, 1.0] * 4), (40, None),
            (80, [0.0] * 8), (81, [nan] + [1.0] * 7), (82, [inf] * 8), (83, [None] + [1.0] * 7), (None, [2.0] * 8), (84, [9.0] * 3), (86, [])]
    schema = "vec_id long, embedding array<float>, id string, vector string, block string"
    table = lambda r: spark.createDataFrame([(i, v, "a", "b", "c") for i, v in r], schema).repartition(3)
    got = defaultdict(set)
    for r in search(table(rows), F.col("vec_id") % 20 == 0, k=5, block_rows=16).collect():
        got[(r.query_id)].add((r["rank"], r.vec_id, round(r.score, 5)))
    want = nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5)
    for q in want:
        if q != 20:  # 20 stands for two different vectors; both are asked
            assert got[q] == {(k + 1, i, round(s, 5)) for k, (i, s) in enumerate(want[q])}
    assert len(got[20]) >= 5 and got.keys() == want.keys()
    few = search(table([(20, [1.0, 0.0]), (1, [0.5, 0.5])]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(20, 1, 1, 0.5)]
    assert search(table([]), F.lit(True)).count() == 0


def test_block_index_finds_every_code_within_the_radius():
    from tidemark.llm.hash_search import BlockIndex, distances

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, (500, 2), dtype=np.uint64)
    for radius in (0, 5, 40, 57, 63, 128):
        index = BlockIndex(codes, radius)
        for q in codes[:20] ^ np.uint64(3):
            assert index.within(q).tolist() == np.flatnonzero(distances(codes, q) <= radius).tolist()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        low[find(k)].append((i is None, i))
    return [(i, min(low[find(k)])[1], links[k]) for k, (i, *_) in enumerate(rows)]


def near_rows():
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    rows = []
    for k in range(90):  # a group of near copies, some too far apart for a link of their own
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            words[at] = f"n{rng.integers(50)}"
        rows.append((1000 + k, " ".join(words), "en", "s"))
    rows += [(k, " ".join(f"u{x}" for x in rng.integers(0, 5000, 60)), "en", "s") for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(300 + k, passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 5000, 25)), "en", "s") for k in range(30)]
    rows += [(500, "one two", "a", "b"), (501, "one\n two ", "a", "b"), (502, "one two three four five", "a", "b"), (None, "one two", "a", "b"), (None, None, None, None), (503, None, None, None),
             (504, " ", "a", "b"), (505, "", "a", "b"), (506, "L " * 30_000, "a", "b"), (507, "L " * 30_001, "a", "b"), (508, "dup dup dup", "a", "b"), (508, "dup dup dup", "a", "b"), (None, "lonely", "x", "x")]
    return rows


def test_jaccard_classes_equal_brute_force(spark, monkeypatch):
    from tidemark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 20)  # blocks of a large bucket and group
    rows = near_rows()
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs_of(spark, rows)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute_classes(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    left = jaccard_join.drop_near_copies(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "score"]
    alone = sum(not shingles(t) for _, t, *_ in rows)
    classes = {c for (i, c, _), (_, t, *_) in zip(want, rows, strict=True) if shingles(t)}
    assert left.count() == len(classes) + alone
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard_join.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    from tidemark.llm.jaccard_join import least_matches

    steps = least_matches(0.8, 1e-6)
    rng = np.random.default_rng(6)
    dropped = 0
    for _ in range(20_000):
        equal = rng.random(128) < 0.8
        dropped += any(equal[:n].sum() < m for n, m in steps)
    assert dropped <= 4
    unlike = [rng.random(128) < 0.4 for _ in range(2000)]
    assert sum(all(e[:n].sum() >= m for n, m in steps) for e in unlike) == 0


def test_signature_estimates_jaccard():
    from tidemark.llm.shingles import shingle_set, signature

    a, b = shingle_set(" ".join(f"w{k}" for k in range(2000))), shingle_set(" ".join(f"w{k}" for k in range(200, 2200)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (np.frombuffer(signature(a), "<u2") == np.frombuffer(signature(b), "<u2")).mean()
    assert abs(same - true) < 0.12
    assert len(shingle_set("x " * 70_000 + "y")) == len(shingles("x " * 70_000 + "y"))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language", "exact", "near", "mix", "pack"] and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "1234 5678", "en", "src1", 9), (10_002, None, None, None, None)], docs.schema)
    docs = docs.union(extra)
    rows = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows[name] = docs.collect()
    assert not {10_001, 10_002} & {r.doc_id for r in rows["language"]}
    assert len(rows["language"]) >= spark.read.parquet(f"{SMALL}/documents.parquet").count() - 1
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(rows["language"], key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in rows["exact"]) == sorted(first.values())
    classes = brute_classes([(r.doc_id, r.text) for r in rows["exact"]])
    assert sorted(r.doc_id for r in rows["near"]) == sorted({c for _, c, _ in classes})
    copies = Counter(r.doc_id for r in rows["mix"])
    assert max(copies.values()) <= 2 and copies.keys() <= {r.doc_id for r in rows["near"]}
    packed = [r for r in cp.STAGES[-1][1](spark, docs, SMALL).collect()]
    words = sum(r.length for r in packed)
    n = check_packing([(r.sequence_id, r.offset, r.length) for r in packed], [r.length for r in packed], 1024)
    assert n <= 1.03 * words / 1024 + 2
    done = Counter(r.doc_id for r in packed if r.piece == 0)
    assert done == copies
    ids = {r.doc_id: [*library_ids("byte_bpe_50k.json", r.text), 2] for r in rows["mix"][:5]}
    for r in packed:
        if r.doc_id in ids:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    whole = cp.run(spark, SMALL)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert whole.count() >= len(packed) * 0.95
