"""Print the physical-plan facts of the headline plans (python tools/plan_report.py [sf_dir]).

For each plan: scans with their ReadSchema / PushedFilters / PartitionFilters, the number of shuffle
exchanges, broadcast and sort-merge joins, and map-side group limits (WindowGroupLimit).
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def facts(name: str, df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    fmt = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    lines = [f"### {name}", ""]
    def nodes(op: str) -> int:
        return len(re.findall(rf"^\(\d+\) {op}\b", fmt, flags=re.M))

    lines.append(f"- shuffle exchanges: {nodes('Exchange')}, broadcast exchanges: {nodes('BroadcastExchange')}")
    lines.append(f"- broadcast hash joins: {nodes('BroadcastHashJoin')}, sort-merge joins: {nodes('SortMergeJoin')}")
    lines.append(f"- window group limits (map-side and final): {nodes('WindowGroupLimit')}")
    for key in ("ReadSchema", "PushedFilters", "PartitionFilters"):
        seen = sorted(set(m.strip() for m in re.findall(rf"{key}: (.*)", fmt)))
        for v in seen[:4]:
            lines.append(f"- {key}: `{v[:160]}`")
    del plan
    return "\n".join(lines) + "\n"


def main(sf_dir: str) -> None:
    from pyspark.sql import functions as F

    from tidemark.operators import rank
    from tidemark.operators.index import index_documents_table
    from tidemark.session import ensure_checkpoint_dir, get_spark
    from tidemark.sources import index_store
    from tidemark.sources.tables import read_table

    spark = get_spark("local[8]")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    idx = index_documents_table(docs)
    out = ["# Physical plans of the headline jobs", "", f"Generated by `tools/plan_report.py {sf_dir}`.", ""]
    out.append(facts("index build: postings of `documents`", idx.postings))
    index_store.write_version(idx, root, 1)
    stored = index_store.read_version(spark, root, 1)
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                             F.col("text").alias("query"))
    one = spark.createDataFrame([(0, "that and onesen")], "query_id long, query string")
    out.append(facts("single query on the stored index", rank.bm25_search(stored, one)))
    out.append(facts("query batch on the stored index", rank.bm25_search(stored, queries)))
    out.append(facts("query batch with a cap of 5000 postings a term", rank.bm25_search(stored, queries, 20, 5000)))
    shown = rank.with_document_fields(rank.bm25_search(stored, one), stored)
    out.append(facts("single query with display fields", shown))
    print("\n".join(out))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
