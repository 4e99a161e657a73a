"""Toxicity and language scores, and near copies on a chain, against plain Python."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

DOCS = "`the.id` long, `the.text` string, lang string, score double, id long, terms string"


def labelled_rows():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(240):
        bad = k % 3 == 0
        words = [f"plain{'abcdefgh'[rng.integers(8)]}" for _ in range(int(rng.integers(1, 9)))] + (["vermin"] * (k % 2) + ["filth"] if bad else ["garden"] * (k % 2))
        rows.append((k, " ".join(words), "en", 0.5, -k, "x", int(bad)))
    rows[7] = (7, "word " * 200_000 + "vermin", "en", 0.5, 0, "x", 1)  # one long text with few terms
    rows[8] = (8, None, None, None, None, None, 0)
    rows[9] = (9, "", "en", 0.5, 0, "x", None)
    return rows


def plain_terms(text):
    return {zlib.crc32(w.encode()) % 2**18 for w in re.findall(r"[^\W\d_]+", (text or "").lower())}


def plain_chosen(rows):
    """Terms of three rows or more that a chi-square test links to the label at all."""
    found = [(plain_terms(t), y) for _, t, *_, y in rows if y is not None]
    n, pos = len(found), sum(y for _, y in found)
    seen, both = Counter(t for s, _ in found for t in s), Counter(t for s, y in found if y for t in s)
    return {t for t, k in seen.items() if k >= 3 and k < n and not math.isclose(both[t], k * pos / n)}


def test_toxicity_scores_are_the_written_out_pairwise_sum(spark):
    from tidemark.llm.toxicity import score, train

    rows = labelled_rows()
    docs = spark.createDataFrame([r[:6] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows], "`the.id` long, `is.toxic` int")
    machine = train(docs, labels, learn=F.lit(True), id_col="the.id", text_col="the.text", label_col="is.toxic")
    slots = {t: int(machine.slot[t]) for t in range(2**18) if machine.slot[t] >= 0}
    assert set(slots) == plain_chosen(rows)
    for r in score(docs, machine, id_col="the.id", text_col="the.text").collect():
        held = sorted(slots[t] for t in plain_terms(rows[r["the.id"]][1]) if t in slots)
        z = machine.bias + sum(float(machine.weights[s]) for s in held)
        for a, b in itertools.combinations(held, 2):
            z += sum(float(x) * float(y) for x, y in zip(machine.factors[a], machine.factors[b], strict=True))
        want = 1 / (1 + math.exp(-z))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == int(want >= 0.5)
    assert machine.score(np.array(sorted(plain_terms("vermin filth")))) > 0.5


def test_toxicity_terms_on_the_driver_do_not_grow_with_the_texts(spark, monkeypatch):
    from tidemark.llm import toxicity

    monkeypatch.setattr(toxicity, "SELECTED", 2)
    letters = "abcdefghij"
    long = " ".join("".join(letters[int(c)] for c in f"{k:05d}") for k in range(30_000))
    rows = [(k, f"vermin {long}" if k % 2 else f"garden {long}", k % 2) for k in range(8)]
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda found, labels: seen.extend(found) or fit(found, labels))
    machine = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
                             spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), learn=F.lit(True))
    assert len(seen) == 8 and all(len(f) <= 2 for f in seen)
    assert machine.score(toxicity.terms("vermin")) > 0.5 > machine.score(toxicity.terms("garden"))


def plain_profile(text, letter):
    """A text's bundled trigrams as plain lists: blanks at both ends, runs of other characters one blank, lower case."""
    spaced = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    total = [0] * 1024
    for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False):
        va, vb, vc = letter(a), letter(b), letter(c)
        for at in range(1024):
            total[at] += va[at - 2] * vb[at - 1] * vc[at]
    return total


def test_language_scores_are_cosines_with_plain_profiles(spark):
    from tidemark.llm.language import Encoder, identify, prototypes

    e = Encoder()
    drawn = {}

    def letter(c):
        if c not in drawn:
            drawn[c] = [int(x) for x in e._vector(0 if c == " " else ord(c))]
        return drawn[c]

    def unit(v):
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    learn = [(1, "the cat, and that other thing", "en"), (2, "they thought it through", "en"), (3, "und die katze sitzt", "de"), (4, "nicht auf dem großen tisch", "de"),
             (4, "nicht auf dem großen tisch", "de"), (5, None, "de"), (6, "12 34", "en"), (7, "le chat noir", None)]
    docs = spark.createDataFrame([(i, t, g, 0.1, 5, "x") for i, t, g in learn], DOCS.replace("lang string", "`the.lang` string"))
    learned = prototypes(docs, learn=F.lit(True), id_col="the.id", text_col="the.text", lang_col="the.lang")
    plain = {}
    for lang in ("de", "en"):
        own = [unit(plain_profile(t, letter)) for _, t, g in learn if g == lang and t and re.search(r"[a-z]", t)]
        plain[lang] = unit([sum(x) for x in zip(*own, strict=True)])
    asked = [(10, "the thing", "q"), (11, "die TISCH-katze!", "q"), (12, "a", "q"), (13, "7 + 8", "q"), (14, None, "q"), (15, "großen thought, großen", "q")]
    out = identify(spark.createDataFrame([(i, t, g, 0.1, 5, "x") for i, t, g in asked], DOCS), learned, text_col="the.text", keep=["the.id"])
    got = {r["the.id"]: (r.lang_pred, r.score) for r in out.collect()}
    for i, text, _ in asked:
        if not text or not re.search("[a-z]", text):
            assert got[i] == ("und", 0.0)
            continue
        v = unit(plain_profile(text, letter))
        near = {g: sum(x * y for x, y in zip(v, p, strict=True)) for g, p in plain.items()}
        best = max(near, key=near.get)
        assert got[i][0] == best and math.isclose(got[i][1], max(0.0, near[best]), abs_tol=1e-5)


def test_a_chain_of_weak_neighbours_stays_apart(spark, monkeypatch):
    """Texts whose neighbours are near 0.7 share buckets and candidates' groups, but no link."""
    from tidemark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 8)
    words = [f"w{k}" for k in range(1000)]
    chain = [(k, " ".join(words[20 * k : 20 * k + 117])) for k in range(40)]
    rows = chain + [(100 + k, " ".join(words[20 * k : 20 * k + 117] + ["tail"])) for k in range(0, 40, 5)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    near = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(39)]
    assert 0.68 < min(near) <= max(near) < 0.72 and alike == {(k, 100 + k) for k in range(0, 40, 5)}
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {
        i: (i - 100 if i >= 100 else i, int(i >= 100 or i % 5 == 0)) for i, _ in rows}


def test_a_long_archive_is_read_in_ranges(tmp_path):
    """200 MB, 64 MB at most held, whether payloads are asked for or not."""
    import tracemalloc

    from tidemark.llm import warc

    big = b"".join(zlib.crc32(k.to_bytes(4, "big")).to_bytes(4, "big") for k in range(1_000_000))
    member = warc.member(warc._record("urn:page:1", "http://a", b"\0" * 20, None, big, warc.DATE), level=0)
    small = warc.member(warc._record("urn:page:2", "http://a", b"\0" * 20, "urn:page:1", b"", warc.DATE))
    with open(tmp_path / "long.warc.gz", "wb") as f:
        for _ in range(50):
            f.write(member + small)
    del member
    assert (tmp_path / "long.warc.gz").stat().st_size > 200_000_000
    for options, n in (({"recordtype": "revisit"}, 50), ({"recordtype": "response", "payload": "false"}, 50), ({}, 100)):
        reader = warc.WarcReader({"path": str(tmp_path), **options})
        tracemalloc.start()
        found = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == n and peak < 64 << 20, (options, found, peak)


def test_ranges_are_the_files_bytes(tmp_path):
    from pyarrow import fs

    from tidemark.llm.warc import _Ranges

    data = np.random.default_rng(2).bytes(5000)
    (tmp_path / "x").write_bytes(data)
    rng = np.random.default_rng(3)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        held = _Ranges(f, f.size(), least=64)
        for _ in range(500):
            a, n = int(rng.integers(0, 5100)), int(rng.integers(0, 300))
            assert held[a : a + n] == data[a : a + n]
        assert held[4990:] == data[4990:] and len(held) == 5000


def test_uncompressed_records_with_long_headers(tmp_path):
    from tidemark.llm import warc

    def record(kind, extra, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    plain = record("response", "X-Long: " + "y" * 50_000 + "\r\n", b"z" * 300_000) + record("metadata", "", b"tail")
    (tmp_path / "a.warc").write_bytes(plain)
    with open(tmp_path / "a.warc", "rb") as f:
        got = list(warc.records(warc._Ranges(f, len(plain), least=1024), lambda fields: True))
    assert [(h["warc-type"], len(b)) for _, h, b in got] == [("response", 300_000), ("metadata", 4)]
    assert got == list(warc.records(plain, lambda fields: True))
