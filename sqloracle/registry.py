"""Registered oracle statements: name -> DuckDB SQL text (same names as the Spark registry)."""

from __future__ import annotations

from sqloracle import activity as ac
from sqloracle import crawl as cr
from sqloracle import pages as pg
from sqloracle import search as s


def oracle_statements() -> dict[str, str]:
    return {
        "postings": s.postings_sql(),
        "doc_lengths": s.doc_lengths_sql(),
        "corpus_stats": s.corpus_stats_sql(),
        "doc_freq": s.doc_freq_sql(),
        "stem_vocab": s.stem_vocab_sql(),
        "query_terms": s.query_terms_sql(s.BENCHMARK_QUERIES),
        "bm25_batch": s.bm25_documents_sql(s.BENCHMARK_QUERIES, None, 20),
        "bm25_capped": s.bm25_documents_sql(s.BENCHMARK_QUERIES, 50, 20),
        "bm25_uncapped": s.bm25_documents_sql(s.BENCHMARK_QUERIES, None, 20),
        "bm25_conversations": s.bm25_documents_sql(s.CONVERSATION_QUERIES, None, 10),
        "page_fields": pg.page_fields_sql(),
        "page_links": pg.page_links_sql(),
        "url_norm": pg.url_norm_sql(),
        "page_documents": pg.page_documents_sql(),
        "page_postings": pg.page_postings_sql(),
        "page_search": pg.page_search_sql(),
        "source_counts": pg.source_counts_sql(),
        "reindex_modes": pg.reindex_modes_sql(),
        "reindex_documents": pg.reindex_documents_sql(),
        "reindex_postings": pg.reindex_postings_sql(),
        "reindex_stats": pg.reindex_stats_sql(),
        "enqueue_new": cr.enqueue_new_sql(),
        "fetch_list": cr.fetch_list_sql(),
        "fetch_gate": cr.fetch_gate_sql(),
        "outcome_queue": cr.outcome_queue_sql(),
        "outcome_domains": cr.outcome_domains_sql(),
        "queue_counts": cr.queue_counts_sql(),
        "bfs_depth": cr.bfs_depth_sql(),
        "robots_allowed": cr.robots_allowed_sql(),
        "robots_stale": cr.robots_stale_sql(),
        "recent_queries": ac.recent_queries_sql(),
        "suggest": ac.suggest_sql(),
        "result_flags": ac.result_flags_sql(),
        "restore_user": ac.restore_user_sql(),
        "dict_cards": ac.dict_cards_sql(),
        # streamed index = batch index on the same input (ST1 invariant)
        "stream_index": pg.page_postings_sql(),
        "page_entities": pg.page_entities_sql(),
        "page_markup": pg.page_markup_sql(),
        "tab_results": pg.tab_results_sql(),
        "first_result": pg.first_result_sql(),
        "search_response": pg.search_response_sql(),
        "bm25_stored": s.bm25_documents_sql(s.BENCHMARK_QUERIES, None, 20),
        "bm25_lookup": s.bm25_documents_sql(s.COMMON_WORDS_QUERY, None, 20),
        "recrawl_same_id": pg.recrawl_same_id_sql(),
        "recrawl_moved_url": pg.recrawl_moved_url_sql(),
        "delete_documents": pg.delete_documents_sql(),
        "delete_stats": pg.delete_stats_sql(),
        # a segment store ends where re-indexing ends
        "segment_documents": pg.segment_documents_sql(),
        "segment_postings": pg.segment_postings_sql(),
        "segment_search": pg.segment_search_sql(),
        "segment_deletions": pg.segment_deletions_sql(),
        "url_hosts": pg.url_hosts_sql(),
        "seed_files": cr.seed_queue_sql(),
        "fetch_schedule": cr.fetch_schedule_sql(),
        "suggest_indexed": ac.suggest_sql(),
        "backup_restore": ac.backup_restore_sql(),
        "history_log": ac.history_log_sql(),
        "word_cards": ac.word_cards_sql(),
        "seed_queue": cr.seed_queue_sql(),
        "blocked_domains": cr.blocked_domains_sql(),
        "history_edit": ac.history_edit_sql(),
    }
