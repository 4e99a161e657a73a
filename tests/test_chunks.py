"""Search by blocks of queries over chunks of whole documents: nothing that is shuffled or kept grows with queries x documents."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_rank_reindex import PAGES, corpus, plain_bm25

from tidemark.operators import blocks, rank
from tidemark.operators import index as ix

TEXTS = ["trains", "onion soup", "evening mountains engine", "the", "onions evening trains", "absent words"]


def answers(spark, index, limit=2, **kw):
    qterms = rank.query_terms(spark.createDataFrame(list(enumerate(TEXTS)), "query_id long, query string"))
    n_docs, avg = index.stats.select("doc_count", rank.bm25.safe_avg(F.col("avg_length"))).first()
    asked = qterms.join(index.with_df(qterms.select("term").distinct()), "term")
    asked = asked.select("query_id", F.col("term").alias("key"), rank.bm25.idf(F.lit(n_docs), F.col("df")).alias("weight"))
    return blocks.best_in_chunks(index.runs, asked, asked.count(), limit, avg, **kw)


@pytest.mark.parametrize(("terms", "held"), [(1 << 20, 1 << 22), (1, 1), (3, 5)])
def test_blocks_and_chunks_of_any_size_give_the_ranking(spark, terms, held):
    index = ix.build_index(corpus(spark).repartition(3))
    found = rank.top_k(answers(spark, index, block_query_terms=terms, held_postings=held), 2)
    for i, text in enumerate(TEXTS):
        rows = found.filter(F.col("query_id") == i).orderBy("rank").collect()
        assert [(r.doc_id, round(r.score, 3), r.total_hits) for r in rows] == plain_bm25(text, PAGES)[:2], text


def test_results_of_a_block_of_queries_do_not_grow_with_the_chunks(spark):
    """40 chunks of documents, enough blocks of queries for all cores: each query leaves ``limit`` rows, not ``limit`` a chunk."""
    index = ix.build_index(corpus(spark, [(i, f"https://a.test/{i}", "", f"common word{i % 7}") for i in range(400)]))
    queries = spark.createDataFrame([(i, "common") for i in range(50)], "query_id long, query string")
    scored = rank.materialize(rank.scored_postings(index, spark.createDataFrame([("common", 7)], "term string, number long")))
    numbered = rank.materialize(queries.select("query_id", F.lit(7).cast("long").alias("number")))
    first = rank.best_of_blocks(scored, numbered, 3, block_postings=10, block_query_terms=2)
    assert first.count() == 50 * 3
    assert {(r.part_rank, r.doc_id, r.part_hits) for r in first.collect()} == {(1, 0, 400), (2, 1, 400), (3, 2, 400)}


def test_a_search_of_a_new_index_shuffles_no_postings(spark):
    index = ix.build_index(corpus(spark))
    found = answers(spark, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "doc_ids" not in plan and "tf_body" not in plan


def test_ties_nulls_and_repeated_ids(spark):
    rows = [(9, "u", "", "river"), (3, "v", "", "river"), (None, "w", "", "river"), (None, "x", "", "river"), (5, "y", "", "river"), (5, "z", "", "delta")]
    index = ix.build_index(corpus(spark, rows))
    held = index.runs.select("chunk", F.explode("doc_ids").alias("doc_id")).distinct()
    assert held.count() == held.select("doc_id").distinct().count() == 4  # a document is in one chunk, also where its rows were added up
    got = rank.bm25_search(index, spark.createDataFrame([(0, "rivers")], "query_id long, query string"), 10).orderBy("rank").collect()
    by_join = rank.scored_postings(index, spark.createDataFrame([("river", 1)], "term string, number long")).collect()
    want = sorted(((-round(r.score, 9), r.doc_id is not None, r.doc_id or 0) for r in by_join))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[1:] for w in want]
    assert {r.total_hits for r in got} == {4}


def test_chunks_out_of_order_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1], [1.0]), (0, "a", [2], [1.0])], "chunk int, term string, doc_ids array<long>, score array<double>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/odd")
    files = spark.read.parquet(f"{tmp_path}/odd").inputFiles()
    before, blocks.READ_ROWS = blocks.READ_ROWS, 1
    try:
        with pytest.raises(ValueError, match="one after the other"):
            list(blocks._held(files, pa.array(["a"]), np.array([1.0]), None, 10))
    finally:
        blocks.READ_ROWS = before


def met(queries, limit, *chunks):
    """(doc_id, score, hits) by query, of chunks of (key, doc_id, score), each met as a block of its own or, in a list, with others."""
    rows = [(q, k) for q, keys in queries.items() for k in keys]
    block = blocks._Queries(pa.table({"query_id": [r[0] for r in rows], "key": [r[1] for r in rows], "weight": [1.0] * len(rows)}), limit)
    place = {k: i for i, k in enumerate(block.keys.to_pylist())}
    for held in chunks:
        kept = [[p for p in chunk if p[0] in place] for chunk in held]
        parts = [(np.array([place[k] for k, *_ in c], np.int32), np.array([x for *_, x in c]), pa.array([d for _, d, _ in c], pa.int64())) for c in kept if c]
        block.meet(blocks._Documents([blocks._one_chunk([p]) for p in parts], block))
    out = {}
    for r in block.best().to_pylist():
        out.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9), r["part_hits"]))
    return out


def test_a_better_first_chunk_leaves_room_for_the_next():
    later = [(0, i, 1.0 + i / 100) for i in range(20)]
    assert met({"q": [0]}, 3, [[(0, 99, 9.0)]], [later]) == {"q": [(99, 9.0, 21), (19, 1.19, 21), (18, 1.18, 21)]}


@pytest.mark.parametrize("seed", range(4))
def test_bounds_by_units_lose_nothing(seed):
    """Against plain sums: ties, a null id, terms of all documents, queries of one term and of most terms."""
    rng = np.random.default_rng(seed)
    ids = [None, *rng.permutation(5000)[:799].tolist()]
    rng.shuffle(ids)
    ends = [0, 3, 150, 400, 800]
    postings = [[(k, d, float(x)) for d in ids[a:b] for k in np.flatnonzero(rng.random(200) < np.linspace(0.001, 0.9, 200)).tolist()
                 for x in [rng.choice([0.5, 1.25, 2.0]) if k % 2 else rng.random() * 20]] for a, b in zip(ends, ends[1:], strict=False)]
    queries = {i: rng.choice(200, n, replace=False).tolist() for i, n in enumerate([1, 1, 2, 3, 5, 8, 20, 60, 150, 199] * 3)}
    got = met(queries, 6, postings[:1], postings[1:2], postings[2:])
    for q, keys in queries.items():
        sums, asked = {}, set(keys)
        for k, d, x in (p for chunk in postings for p in chunk if p[0] in asked):
            sums[d] = sums.get(d, 0) + x
        want = sorted(sums, key=lambda d: (-round(sums[d], 9), d is not None, d or 0))[:6]
        assert [d for d, *_ in got.get(q, [])] == want, q
        assert all(abs(x - sums[d]) < 1e-8 and n == len(sums) for d, x, n in got.get(q, []))
