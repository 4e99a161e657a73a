"""BM25 maths (B1-B5, B9) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking function.
K1 = 1.5
B = 0.75
TITLE_BOOST = 4


def idf(n_docs: Column, df: Column) -> Column:
    """B1: ln(1 + (N - df + 0.5) / (df + 0.5)); never negative."""
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weighted_tf(tf_body: Column, tf_title: Column) -> Column:
    """B2: a title occurrence counts as TITLE_BOOST body occurrences."""
    return F.coalesce(tf_body, F.lit(0)) + F.lit(TITLE_BOOST) * F.coalesce(tf_title, F.lit(0))


def safe_avg(avg_len: Column) -> Column:
    """An average length that is not positive becomes 1."""
    return F.when(avg_len > 0, avg_len).otherwise(F.lit(1.0))


def doc_length_or_avg(doc_len: Column, avg_safe: Column) -> Column:
    """A document length of 0 or missing is scored with the (safe) average."""
    return F.when(F.coalesce(doc_len, F.lit(0)) > 0, doc_len.cast("double")).otherwise(avg_safe)


def term_score(term_idf: Column, tf: Column, doc_len: Column, avg_safe: Column) -> Column:
    """Idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)), of columns or of Numpy arrays of doubles."""
    denom = tf + K1 * ((1.0 - B) + B * (doc_len / avg_safe))
    return term_idf * ((tf * (K1 + 1.0)) / denom)


def display_score(score: Column) -> Column:
    """Rounded to 3 decimals for display; ordering uses the full value."""
    return F.round(score, 3)


def rank_key(score: Column) -> Column:
    """Score used for ordering: rounded far below any meaningful difference, so that sums taken in a
    different order (another engine, another partitioning) still give the same ranking."""
    return F.round(score, 9)


def result_id(doc_id: Column) -> Column:
    """B9: 'idx-' + document id."""
    return F.concat(F.lit("idx-"), doc_id.cast("string"))
