"""BM25 search over an index for a table of queries (T2, A2-A4, A9, B1-B6, J2-J4, W1, W2, L1-L4, PF7,
PF8, A7, SC7).

Plan for a batch of queries (a single query string is a one-row batch):

1. query terms: T2 words -> stems -> distinct (query_id, term), written; each distinct term gets its df
2. an index that has just been built has its postings in chunks of whole documents already. From another one, or under a cap, the postings
   of asked terms are scored (a join on term, and on the bucket column of a stored index, which prunes folders) and dealt into such chunks
3. queries are dealt into blocks; a task holds a block and reads the chunks, sums the scores per (query, doc) (A3) in Numpy and keeps the
   best ``limit`` and the number of hits of each query (``blocks.py``)
4. total hits (A4) and top-``limit`` (W2) over limit rows a query, times the shares of the chunks where there are fewer blocks than cores

So what is shuffled is queries and results, and at most once the postings of asked terms: no amount that grows with the product of queries
and documents. A task holds one block of queries and a few chunks. Small sides are broadcast by the
planner's own size rule. The per-term cap (W1) is an option of its own: two-level, top-``cap`` per (term, map-partition
group), then per term, with document frequencies counted after the cap (A2, K1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bm25
from tidemark.functions.stem import add_stem
from tidemark.functions.text import query_words
from tidemark.functions.urls import classify_source
from tidemark.operators.blocks import BLOCK_QUERY_TERMS, HELD_POSTINGS, best_in_chunks, in_chunks
from tidemark.operators.index import Index
from tidemark.operators.util import materialize

DEFAULT_LIMIT = 20
CAP_FANIN = 32
#: Postings of a chunk of documents, about, and postings below which a chunk is not split further to keep all cores busy.
BLOCK_POSTINGS = 1 << 20
LEAST_POSTINGS = 1 << 15

# Result tabs of the search page and the sources each one shows.
TABS = {
    "all": None,
    "movies": ["archive", "vimeo", "streaming"],
    "google": ["google"],
    "wikipedia": ["wikipedia"],
    "youtube": ["youtube"],
    "instagram": ["instagram"],
}


def resolve_limit(limit) -> int:
    """K3: 0 or missing -> 20; a negative limit is refused."""
    if limit is None or limit == 0:
        return DEFAULT_LIMIT
    limit = int(limit)
    if limit < 0:
        raise ValueError("limit must be positive")
    return limit


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term): distinct stemmed query terms (T2, A9). Blank queries give no rows (PF8)."""
    words = queries.select(F.col(id_col).alias("query_id"), F.explode(query_words(F.col(text_col))).alias("word"))
    return add_stem(words, "word", "term").select("query_id", "term").distinct()


def cap_postings(cand: DataFrame, cap: int, fanin: int = CAP_FANIN) -> DataFrame:
    """Keep the ``cap`` postings of each term with the highest tf_body + tf_title (doc_id breaks ties)."""
    order = [(F.col("tf_body") + F.col("tf_title")).desc(), F.col("doc_id").asc()]
    grouped = cand.withColumn("_grp", F.pmod(F.spark_partition_id(), F.lit(fanin)))
    level1 = (
        grouped.withColumn("_rn", F.row_number().over(Window.partitionBy("term", "_grp").orderBy(*order)))
        .filter(F.col("_rn") <= cap)
        .drop("_rn", "_grp")
    )
    return (
        level1.withColumn("_rn", F.row_number().over(Window.partitionBy("term").orderBy(*order)))
        .filter(F.col("_rn") <= cap)
        .drop("_rn")
    )


def scored_postings(index: Index, asked: DataFrame, max_postings_per_term: int | None = None, fanin: int = CAP_FANIN) -> DataFrame:
    """(number, doc_id, score): BM25 of every posting of the distinct terms ``asked`` (term, number), in full precision."""
    if max_postings_per_term is None:
        rows = index.matches(materialize(index.with_df(asked)))
    else:
        # df after the cap (K1): a count over the same term partitioning as the cap, no extra exchange
        capped = cap_postings(index.matches(asked), int(max_postings_per_term), fanin)
        rows = capped.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    # N and the (safe) average length are scalar subqueries over the one-row stats table
    n_docs = index.stats.select("doc_count").scalar()
    avg_safe = index.stats.select(bm25.safe_avg(F.col("avg_length"))).scalar()
    tf = bm25.weighted_tf(F.col("tf_body"), F.col("tf_title"))
    score = bm25.term_score(bm25.idf(n_docs, F.col("df")), tf, bm25.doc_length_or_avg(F.col("doc_len"), avg_safe), avg_safe)
    return rows.filter(tf > 0).select("number", "doc_id", score.alias("score"))


def best_of_blocks(scored: DataFrame, qterms: DataFrame, limit: int, block_postings: int = BLOCK_POSTINGS,
                   block_query_terms: int = BLOCK_QUERY_TERMS) -> DataFrame:
    """(query_id, doc_id, score, part_rank, part_hits) of ``best_in_chunks`` for postings that do not stand in chunks: they are dealt into some.

    ``scored`` (number, doc_id, score) and ``qterms`` (query_id, number) are written tables.
    """
    n_postings, n_terms = scored.count(), qterms.count()
    # enough chunks for all cores, as long as they are worth a task each
    spread = min(2 * scored.sparkSession.sparkContext.defaultParallelism, -(-n_postings // LEAST_POSTINGS))
    chunks = in_chunks(scored, "number", ["score"], max(1, spread, -(-n_postings // block_postings)))
    asked = qterms.select("query_id", F.col("number").alias("key"), F.lit(1.0).alias("weight"))
    return best_in_chunks(chunks, asked, n_terms, limit, block_query_terms=block_query_terms, held_postings=min(HELD_POSTINGS, block_postings))


def top_k(first: DataFrame, limit: int) -> DataFrame:
    """W2 + L1 + A4: rank by score (doc_id breaks ties), keep ranks <= limit, with the query's total hits."""
    whole = Window.partitionBy("query_id")
    hits = F.sum(F.when(F.col("part_rank") == 1, F.col("part_hits")).otherwise(0)).over(whole)
    ranked = whole.orderBy(bm25.rank_key(F.col("score")).desc(), F.col("doc_id").asc())
    return first.withColumn("rank", F.row_number().over(ranked)).withColumn("total_hits", hits).filter(F.col("rank") <= limit)


def bm25_search(index: Index, queries: DataFrame, limit=DEFAULT_LIMIT,
                max_postings_per_term: int | None = None, id_col: str = "query_id",
                text_col: str = "query", fanin: int = CAP_FANIN) -> DataFrame:
    """(query_id, rank, doc_id, score, total_hits); score rounded to 3 decimals (B5). Exact unless a cap is named.

    Queries without any hit give no rows; ``search_response`` turns them into totalHits 0.
    """
    limit = resolve_limit(limit)
    qterms = materialize(query_terms(queries, id_col, text_col))
    if index.runs is not None and max_postings_per_term is None:
        n_docs, avg_safe = index.stats.select("doc_count", bm25.safe_avg(F.col("avg_length"))).first()
        known = materialize(index.with_df(qterms.select("term").distinct()))
        weighed = known.select("term", bm25.idf(F.lit(n_docs), F.col("df")).alias("weight"))
        asked = qterms.join(weighed, "term").select("query_id", F.col("term").alias("key"), "weight")
        first = best_in_chunks(index.runs, asked, qterms.count(), limit, avg_safe)
    else:
        asked = materialize(qterms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
        scored = materialize(scored_postings(index, asked, max_postings_per_term, fanin))
        first = best_of_blocks(scored, qterms.join(asked, "term").select("query_id", "number"), limit)
    return top_k(first, limit).select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "doc_id",
        bm25.display_score(F.col("score")).alias("score"),
        "total_hits",
    )


def search_one(index: Index, query: str | None, limit=DEFAULT_LIMIT, query_id: int = 0) -> DataFrame:
    """``bm25_search`` for one query string. Its terms are looked up first, so that a stored index is read only where they occur.

    The results are those of a batch of one query; a null or blank string gives no rows.
    """
    spark = index.postings.sparkSession
    asked = spark.range(1).select(F.lit(query_id).alias("query_id"), F.lit(query).cast("string").alias("query"))
    return bm25_search(index.narrowed(query_terms(asked)), asked, limit)


def with_document_fields(results: DataFrame, documents: DataFrame | Index) -> DataFrame:
    """Late materialisation (J3 after top-k): url, title, snippet and source for the kept results only.

    Only the four display columns of the documents are read; with an index stored by document bucket the bucket prunes folders.
    """
    if isinstance(documents, Index):
        joined = documents.documents_of(results)
    else:
        joined = documents.select("doc_id", "url", "title", "snippet").join(results, "doc_id")
    return joined.select(
        "query_id", "rank", bm25.result_id(F.col("doc_id")).alias("id"), "doc_id", "url", "title", "snippet",
        "score", classify_source(F.col("url")).alias("source"), "total_hits",
    )


def tab_filter(results: DataFrame, tab: str, display_limit: int | None = None) -> DataFrame:
    """PF7 + L4: keep one tab's sources, then re-rank and keep the first ``display_limit``."""
    sources = TABS[tab]
    out = results if sources is None else results.filter(F.col("source").isin(*sources))
    w = Window.partitionBy("query_id").orderBy(F.col("rank").asc())
    out = out.withColumn("tab_rank", F.row_number().over(w))
    if display_limit is not None:
        out = out.filter(F.col("tab_rank") <= display_limit)
    return out


def tab_counts(results: DataFrame) -> DataFrame:
    """Per query, how many results each tab would show, in one aggregation pass."""
    src = F.col("source")
    aggs = [F.count(F.lit(1)).alias("all")]
    for tab, sources in TABS.items():
        if sources is not None:
            aggs.append(F.count_if(src.isin(*sources)).alias(tab))
    return results.groupBy("query_id").agg(*aggs)


def search_response(queries: DataFrame, results: DataFrame, id_col: str = "query_id",
                    text_col: str = "query") -> DataFrame:
    """SC7: one row per query, {query, totalHits, results[]} as a struct and as JSON text.

    Every query appears, hits or not (PF8: totalHits 0 and an empty list).
    """
    packed = results.groupBy("query_id").agg(
        F.max("total_hits").alias("totalHits"),
        F.array_sort(
            F.collect_list(F.struct("rank", "id", "url", "title", "snippet", "score", "source"))
        ).alias("results"),
    )
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query"))
    out = q.join(packed, "query_id", "left").select(
        "query_id",
        "query",
        F.coalesce(F.col("totalHits"), F.lit(0)).alias("totalHits"),
        F.coalesce(F.col("results"), F.array()).alias("results"),
    )
    body = F.struct(F.col("query"), F.col("totalHits"), F.transform("results", _drop_rank).alias("results"))
    return out.withColumn("json", F.to_json(body))


def _drop_rank(r: Column) -> Column:
    return F.struct(
        r["id"].alias("id"), r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"),
        r["score"].alias("score"), r["source"].alias("source"),
    )
