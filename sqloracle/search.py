"""Oracle SQL for the index and BM25 queries over ``documents`` (and ``pages``)."""

from __future__ import annotations

from sqloracle.text import STOP_SQL, keep_word, stem_ctes, words_of


def documents_index_ctes(extra_vocab: str | None = None) -> str:
    """CTEs: d, dw, dk (kept words), dlen (doc_id, body_length), stems (word, term), post (postings).

    ``extra_vocab`` is a relation with a ``word`` column whose words are stemmed too (query words).
    """
    vocab_sql = "SELECT DISTINCT word FROM dk" + (f" UNION SELECT word FROM {extra_vocab}" if extra_vocab else "")
    return f"""
d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0),
dw AS (SELECT doc_id, unnest({words_of('text')}) AS word FROM d),
dk AS (SELECT doc_id, word FROM dw WHERE {keep_word('word')}),
dlen AS (SELECT d.doc_id, CAST(count(dk.word) AS INTEGER) AS body_length FROM d LEFT JOIN dk ON d.doc_id = dk.doc_id
         GROUP BY d.doc_id),
vocab AS ({vocab_sql}),
{stem_ctes('vocab', 'stems')},
post AS (SELECT s.term, k.doc_id, CAST(count(*) AS INTEGER) AS tf_body, CAST(0 AS INTEGER) AS tf_title
         FROM dk k JOIN stems s ON k.word = s.word GROUP BY s.term, k.doc_id)"""


def query_word_ctes(src_sql: str, prefix: str = "q") -> str:
    """CTEs {prefix}sel(query_id, word): T2 query words (index words, else all raw words)."""
    return f"""
{prefix}raw AS (SELECT query_id, unnest({words_of('qtext')}) AS word FROM ({src_sql})),
{prefix}flag AS (SELECT query_id, word, {keep_word('word')} AS k FROM {prefix}raw),
{prefix}has AS (SELECT DISTINCT query_id FROM {prefix}flag WHERE k),
{prefix}sel AS (SELECT query_id, word FROM {prefix}flag
                WHERE k OR query_id NOT IN (SELECT query_id FROM {prefix}has))"""


def bm25_tail(post: str, dlen: str, qterms: str, cap: int | None, limit: int) -> str:
    """CTEs from postings/doc lengths/query terms to bm25res(query_id, rank, doc_id, score, total_hits)."""
    capped = (
        f"""capped AS (SELECT term, doc_id, tf_body, tf_title FROM (
             SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf_body + tf_title DESC, doc_id) AS rn
             FROM cand) WHERE rn <= {cap}),"""
        if cap is not None
        else "capped AS (SELECT term, doc_id, tf_body, tf_title FROM cand),"
    )
    return f"""
st AS (SELECT count(*) AS n, coalesce(sum(body_length), 0) AS total FROM {dlen}),
st2 AS (SELECT n, CASE WHEN (CASE WHEN n > 0 THEN total / n ELSE 0 END) > 0 THEN total / n ELSE 1.0 END AS avg_safe
        FROM st),
cand AS (SELECT * FROM {post} WHERE term IN (SELECT term FROM {qterms})),
{capped}
dfq AS (SELECT term, count(*) AS df FROM capped GROUP BY term),
tsr AS (
  SELECT qt.query_id, c.doc_id,
         CAST(c.tf_body + 4 * c.tf_title AS DOUBLE) AS tf,
         ln(1.0 + (st2.n - f.df + 0.5) / (f.df + 0.5)) AS idf,
         CASE WHEN coalesce(l.body_length, 0) > 0 THEN CAST(l.body_length AS DOUBLE) ELSE st2.avg_safe END AS dl,
         st2.avg_safe AS avg_safe
  FROM capped c JOIN dfq f ON c.term = f.term JOIN {qterms} qt ON c.term = qt.term
       LEFT JOIN {dlen} l ON c.doc_id = l.doc_id CROSS JOIN st2),
sc AS (SELECT query_id, doc_id, sum(idf * ((tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / avg_safe))))) AS score
       FROM tsr WHERE tf > 0 GROUP BY query_id, doc_id),
tot AS (SELECT query_id, count(*) AS total_hits FROM sc GROUP BY query_id),
rk AS (SELECT query_id, doc_id, score,
              row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM sc),
bm25res AS (SELECT rk.query_id, CAST(rk.rnk AS INTEGER) AS rank, rk.doc_id, round(rk.score, 3) AS score,
                   tot.total_hits
            FROM rk JOIN tot ON rk.query_id = tot.query_id WHERE rk.rnk <= {limit})"""


def postings_sql() -> str:
    return f"WITH {documents_index_ctes()}\nSELECT term, doc_id, tf_body, tf_title FROM post"


def doc_lengths_sql() -> str:
    return f"WITH {documents_index_ctes()}\nSELECT doc_id, body_length FROM dlen"


def corpus_stats_sql() -> str:
    return f"""WITH {documents_index_ctes()}
SELECT count(*) AS doc_count, CAST(coalesce(sum(body_length), 0) AS BIGINT) AS total_length,
       CASE WHEN count(*) > 0 THEN sum(body_length) / count(*) ELSE 0.0 END AS avg_length FROM dlen"""


def doc_freq_sql() -> str:
    return f"WITH {documents_index_ctes()}\nSELECT term, count(*) AS df FROM post GROUP BY term"


def stem_vocab_sql() -> str:
    return f"WITH {documents_index_ctes()}\nSELECT word, term FROM stems"


def query_terms_sql(src_sql: str) -> str:
    return f"""WITH {query_word_ctes(src_sql)},
vocab AS (SELECT DISTINCT word FROM qsel),
{stem_ctes('vocab', 'stems')}
SELECT DISTINCT query_id, term FROM qsel JOIN stems ON qsel.word = stems.word"""


BENCHMARK_QUERIES = "SELECT item_id AS query_id, text AS qtext FROM benchmark"
CONVERSATION_QUERIES = "SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS query_id, text AS qtext FROM conversations"

#: One query: the three index words that the most benchmark items hold.
COMMON_WORDS_QUERY = f"""SELECT 0 AS query_id, string_agg(word, ' ' ORDER BY word) AS qtext FROM (
  SELECT word FROM (SELECT DISTINCT item_id, unnest({words_of('text')}) AS word FROM benchmark)
  WHERE {keep_word('word')} GROUP BY word ORDER BY count(*) DESC, word LIMIT 3)"""


def bm25_documents_sql(src_sql: str, cap: int | None, limit: int) -> str:
    return f"""WITH {query_word_ctes(src_sql)},
{documents_index_ctes(extra_vocab='qsel')},
qterms AS (SELECT DISTINCT query_id, term FROM qsel JOIN stems ON qsel.word = stems.word),
{bm25_tail('post', 'dlen', 'qterms', cap, limit)}
SELECT * FROM bm25res"""


__all__ = ["STOP_SQL", "postings_sql", "doc_lengths_sql", "corpus_stats_sql", "doc_freq_sql", "stem_vocab_sql",
           "query_terms_sql", "bm25_documents_sql", "BENCHMARK_QUERIES", "COMMON_WORDS_QUERY", "CONVERSATION_QUERIES"]
