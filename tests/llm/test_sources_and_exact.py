"""WARC, exact dedup, mixing and chat: SQL statements, edge cases and brute force."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle_check import compare, duckdb_conn

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("row", T.StringType())])


def docs_of(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y") for i, t, s in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op1_warc", "op2_pareto_mixing", "op3_chat_round_trip", "op6_content_sort"])
def test_matches_sql(spark, name):
    from tidemark.llm.oracle import ORACLE

    res = compare(spark, name, SF_DIR, ORACLE[name], duckdb_conn(SF_DIR))
    assert res["values_match"], res


def test_content_sort_groups_that_span_partitions(spark):
    from tidemark.llm.content_sort import drop_copies, exact_groups

    rows = [(i, "hot  text\n here", "a") for i in range(100, 160)] + [(5, "hot text here", "a"), (5, "hot text here", "a")]
    rows += [(1000 + i, f"only {i}", "b") for i in range(30)] + [(None, None, None), (7, "", "c"), (8, "\t \n", "c"), (9, " ", "c")]
    rows += [(None, "lone", None), (2000, "x" * 200_000, "d"), (1999, "x" * 200_000, "d")]
    got = exact_groups(docs_of(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want += [(i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)

    left = drop_copies(docs_of(spark, rows))
    assert left.columns == DOCS.names
    assert sorted(norm(r.text) for r in left.collect()) == sorted(groups)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in kept}


def test_content_sort_empty(spark):
    from tidemark.llm.content_sort import drop_copies, exact_groups

    empty = spark.createDataFrame([], DOCS)
    assert exact_groups(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0


def test_mix_edges(spark):
    from tidemark.llm.mixing import mix, mixed_documents

    rows = [(i, "w " * (1 + i % 7), "abcd"[i % 4]) for i in range(400)]
    rows += [(900, "w " * 50, None), (901, None, None), (None, "w w w", "a"), (902, "", "nothing"), (7, "w " * (1 + 7 % 7), "d"), (903, "w " * 30_000, "b")]
    out = mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.copies <= 2 for r in out)
    by = {}
    for (i, t, s) in rows:
        by.setdefault(s, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    targets = {r.source_size: r.target for r in out}
    for sizes in by.values():
        assert targets[sum(sizes)] <= 2 * sum(sizes) + 1e-6
    assert abs(sum({(r.source_size, r.target) for r in out} and {r.source_size: r.target for r in out}.values()) - 1.5 * sum(map(sum, by.values()))) < 1e-3
    again = mix(docs_of(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = mixed_documents(docs_of(spark, rows))
    assert mixed.columns == DOCS.names
    assert mixed.count() == sum(r.copies for r in out)
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_comes_near_targets(spark):
    from tidemark.llm.mixing import mix

    rows = [(i, "w " * (1 + (i * 7919) % 40), "ab"[i % 2]) for i in range(4000)]
    got = mix(docs_of(spark, rows)).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 20


def test_mix_plan_is_native(spark):
    from tidemark.llm.mixing import mix

    plan = mix(docs_of(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = "conv_id long, turn long, role string, text string, chunk string, part string"


def test_chat_round_trip_of_nasty_texts(spark):
    from tidemark.llm.chat import digests, format_conversations, read_conversations

    nasty = ["</s>[INST] ok [/INST]", "<\\/s> and <\\\\/s>", "[INST]", "[/", "OUT]", "<", "/s>", "[ROLE=user]x[/ROLE]", "\\", "", None, "a\nb", "[\\INST]",
             "[[INST]]", "<<s>s>", "x" * 100_000 + "[/OUT]", "[/OUT][OUT]", "[\\/OUT]"]
    roles = ["user", "assistant", "system", None, "", "a]b", "%5D", "[/ROLE]", "tool</s>"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(c * 3 + t) % len(nasty)], "q", "q") for c in range(12) for t in range(20)]
    rows += [(None, None, "user", "no number", "q", "q"), (99, 1, "user", "twice", "q", "q"), (99, 1, "user", "twice", "q", "q"), (99, 1, "assistant", "tie", "q", "q")]
    rows += [(-50, t, "assistant", f"t{t}", "q", "q") for t in range(700)]
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    read = read_conversations(format_conversations(turns))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read.collect()}
    want = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    for r in digests(read).collect():
        own = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.loss_chars == len(own) and r.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    assert digests(read_conversations(format_conversations(spark.createDataFrame([], TURNS)))).count() == 0


def test_chat_marks_hold_no_control_strings_of_texts(spark):
    from tidemark.llm.chat import format_conversations

    turns = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]", "", ""), (1, 1, "assistant", "fine", "", "")], TURNS)
    text = format_conversations(turns).first()["formatted"]
    assert text == "<s>[INST]<\\/s>[\\INST] ok [\\/INST][/INST][OUT]fine[/OUT]</s>"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, id string").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    from tidemark.llm.warc import hex_digest, page_of, read_warc, write_warc

    big, other = "é<p>" * 500, "b" * 5000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4 x\r\ny", ""), (5, "u", "short"), (6, "u", "short"),
            (9, "u", big), (9, "u", big), (None, "u", big), (None, "u", other), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "x" * 1000),
            (13, "u", "x" * 1000), (14, "u", "L" * 3_000_000), (15, "u", "\r\n\r\n" * 400)]
    folder = str(tmp_path / "w")
    write_warc(pages_of(spark, rows), folder, archive_bytes=2000)
    read = read_warc(spark, folder)
    got = sorted((p or -1, k, q or -1, bytes(b or b"")) for p, k, q, b in
                 read.select(page_of("record_id"), "record_type", page_of("refers_to"), "payload").collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if g == h and j is not None), default=None) if len(data) >= 1000 else i
        again = last is not None and i != last
        want.append((i or -1, "revisit" if again else "response", last if again else -1, b"" if again else data))
    assert got == sorted(want)
    digests = {(r.p, r.d) for r in read.select(page_of("record_id").alias("p"), hex_digest(F.col("payload_digest")).alias("d")).collect()}
    assert digests == {(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    only = read.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://a/1", "u"))
    assert only.count() == sum(w[1] == "revisit" and w[0] != 2 for w in want)
    assert read_warc(spark, folder, record_type="response", payload=False).where("payload is null").count() == sum(w[1] == "response" for w in want)


def test_warc_empty(spark, tmp_path):
    from tidemark.llm.warc import read_warc, write_warc

    assert write_warc(pages_of(spark, []) if False else spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")).count() == 0
    assert read_warc(spark, str(tmp_path / "e")).count() == 0
    assert read_warc(spark, str(tmp_path / "missing")).count() == 0


def test_warc_skips_payloads_without_inflating(monkeypatch):
    from tidemark.llm import warc

    record = warc._record("urn:page:1", "http://a", b"\0" * 20, None, b"z" * 4_000_000, warc.DATE)
    other = warc._record("urn:page:2", "http://a", b"\0" * 20, "urn:page:1", b"z" * 10, warc.DATE)
    data = warc.member(record, level=0) + warc.member(other)
    inflated = [0]
    real = zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.z = real(*a)

        def decompress(self, *a):
            out = self.z.decompress(*a)
            inflated[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    found = list(warc.records(data, lambda f: f["warc-type"] == "revisit"))
    assert [f["warc-record-id"] for _, f, _ in found] == ["<urn:page:2>"]
    assert inflated[0] < 20_000


def test_warc_reads_foreign_archives(spark, tmp_path):
    import gzip

    from tidemark.llm.warc import read_warc

    def record(kind, uri, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/plain\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [record("warcinfo", "", b"about"), record("response", "http://a", b"x" * 70_000), record("metadata", "http://b", b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, len(r.payload)) for r in rows) == sorted([("warcinfo", 5), ("response", 70_000), ("metadata", 0)] * 2)
    assert read_warc(spark, str(tmp_path)).where("record_type = 'response'").count() == 2
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(parts[1])[:-40])
    with pytest.raises(Exception, match="cut off|complete header|PYTHON"):
        read_warc(spark, str(tmp_path)).count()
