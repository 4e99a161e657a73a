"""Registered queries against their DuckDB oracle statements (the driver's check), plus entry()."""

import ast
import os
from pathlib import Path

import pytest

from oracle_check import compare, duckdb_conn

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
#: Left to TIDEMARK_ALL_ORACLE=1: queries whose plan another one here already runs.
SLOW = {"doc_lengths", "doc_freq", "stem_vocab", "query_terms", "bm25_uncapped", "page_documents", "page_postings", "source_counts", "reindex_modes", "reindex_postings",
        "queue_counts", "outcome_domains", "robots_stale", "stream_index", "first_result", "delete_documents", "recrawl_moved_url", "enqueue_new", "fetch_gate",
        "segment_postings", "segment_search", "segment_deletions", "seed_files"}


def names():
    from tidemark.plans.registry import QUERIES

    return [n for n in QUERIES if os.environ.get("TIDEMARK_ALL_ORACLE") or n not in SLOW]


def test_every_query_has_an_oracle_statement():
    from sqloracle.registry import oracle_statements
    from tidemark.plans.registry import QUERIES

    assert set(QUERIES) == set(oracle_statements())


def test_oracle_shares_nothing_with_the_spark_code():
    for path in (ROOT / "sqloracle").glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.split(".")[0] == "tidemark" for n in found), path


def test_nothing_else_imports_the_training_data_package():
    for path in [*(ROOT / "tidemark").rglob("*.py"), *(ROOT / "sqloracle").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", names())
def test_query_matches_oracle(spark, name):
    from __spark_entry__ import oracle_sql

    res = compare(spark, name, SF_DIR, oracle_sql()[name], duckdb_conn(SF_DIR))
    assert res["values_match"] and res["types_match"], res


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score", "total_hits"]
    assert df.count() > 0
