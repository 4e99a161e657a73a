"""Index build (A1, A5, J5, PF1, PF2, T1, T3, T5).

A corpus is a DataFrame ``(doc_id, url, domain, title, snippet, body)``. The index is three tables:

    documents  (doc_id, url, domain, title, snippet, body_length, content_hash)
    postings   (term, doc_id, tf_body, tf_title, doc_len)   one row per (term, document)
    stats      (doc_count, total_length)                     one row
    terms      (term, df)                                    one row per term

``doc_len`` repeats the document's body length inside each posting so that scoring never joins the
(large) documents table: a query only reads the postings of its terms.

Plan: one Arrow pass over the documents counts their stemmed words (``count_terms``), written once: a row per document, and a row per
term of every chunk of documents with the documents that hold it (a run of postings). A worker keeps the stems of the words it has met,
so a word is stemmed about once a worker, and nothing is shuffled. Documents, postings, document frequencies and statistics are read from
these rows; a search and the frequencies meet runs, which are far fewer than postings. Rows of one doc_id, where there are several, are
found by their ids alone and only those are added up by (term, doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stem import add_stem, stem_word
from tidemark.functions.text import STOP_WORDS, body_hash, index_words
from tidemark.operators.blocks import in_chunks
from tidemark.operators.util import bucket, materialize


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    terms: DataFrame
    #: The postings in runs, where the index has just been built: a written table in chunks of whole documents.
    runs: DataFrame | None = None
    #: Folders of a stored index by term and by document, 0 where the tables are not stored that way.
    term_buckets: int = 0
    doc_buckets: int = 0

    def _keyed(self, terms: DataFrame) -> tuple[DataFrame, list[str]]:
        if not self.term_buckets:
            return terms, ["term"]
        # the bucket is a partition column, so the join on it prunes folders at run time
        return terms.filter(F.length("term") > 0).withColumn("term_bucket", bucket(F.col("term"), self.term_buckets)), ["term_bucket", "term"]

    def with_df(self, terms: DataFrame) -> DataFrame:
        """``terms`` (a column term among others) with the df of those that occur."""
        asked, keys = self._keyed(terms)
        known = self.terms if self.runs is None else run_frequencies(self.runs.join(terms.select("term"), "term", "left_semi"))
        return asked.join(known, keys).select(*terms.columns, "df")

    def matches(self, terms: DataFrame) -> DataFrame:
        """The postings of ``terms``, one row per posting and row of ``terms``."""
        if self.runs is not None:
            return in_rows(self.runs.join(terms, "term"), *[c for c in terms.columns if c != "term"])
        asked, keys = self._keyed(terms)
        return self.postings.join(asked, keys)

    def narrowed(self, terms: DataFrame) -> Index:
        """This index with only the rows of ``terms`` (a column term), which are few: those of one query string.

        They reach the scans as literals, so folders, row groups (Bloom filters, smallest and largest term) and pages that hold
        none of them are left out before a row is read. Spark pushes up to spark.sql.parquet.pushdown.inFilterThreshold
        terms one by one, more as their range.
        """
        asked, keys = self._keyed(terms.select("term").distinct())
        found = asked.select(*keys).collect()
        postings, frequencies = self.postings, self.terms
        for key in keys:
            values = sorted({r[key] for r in found})
            postings, frequencies = postings.filter(F.col(key).isin(values)), frequencies.filter(F.col(key).isin(values))
        runs = None if self.runs is None else self.runs.filter(F.col("term").isin(sorted(r["term"] for r in found)))
        return replace(self, postings=postings if runs is None else in_rows(runs), terms=frequencies, runs=runs)

    def documents_of(self, found: DataFrame) -> DataFrame:
        """The display columns of the documents in ``found``, joined to its rows."""
        columns = ["doc_id", "url", "title", "snippet"]
        if not self.doc_buckets:
            return self.documents.select(*columns).join(found, "doc_id")
        asked = found.filter(F.col("doc_id").isNotNull()).withColumn("doc_bucket", bucket(F.col("doc_id"), self.doc_buckets))
        return self.documents.select("doc_bucket", *columns).join(asked, ["doc_bucket", "doc_id"]).drop("doc_bucket")


def skip_predicate(url: Column, body: Column, require_url: bool = True) -> Column:
    """PF1: a page without url or with empty body text is skipped."""
    has_body = body.isNotNull() & (F.length(body) > 0)
    if not require_url:
        return has_body
    return url.isNotNull() & (F.length(url) > 0) & has_body


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """The ``documents`` test table as a body-only corpus (no url, empty title)."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("domain"),
        F.lit("").alias("title"),
        F.lit("").alias("snippet"),
        F.col("text").alias("body"),
    )


#: Words whose stems a worker keeps, and words of one chunk of documents, about.
KNOWN_WORDS = 1_000_000
CHUNK_WORDS = 1 << 21
_DISPLAYED = "url string, domain string, title string, snippet string"
#: A row is a document (term is null), or a term with the documents of a chunk that hold it (the other columns are null).
_COUNTED = (f"doc_id bigint, {_DISPLAYED}, body_length int, content_hash string, "
            "chunk int, term string, n_docs int, doc_ids array<bigint>, tf_body array<int>, tf_title array<int>, doc_len array<int>")
_LISTS = ["doc_ids", "tf_body", "tf_title", "doc_len"]
#: A-Z in lower case, [a-z0-9] as it is, a blank for any other byte.
_FOLD = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_STOP = frozenset(STOP_WORDS)


def _words(text: bytes) -> list[bytes]:
    """T1 of UTF-8 text. U+0130 and U+212A are the only characters beyond ASCII whose lower case holds one of [a-z0-9]."""
    if b"\xc4\xb0" in text:
        text = text.replace(b"\xc4\xb0", b"i ")
    if b"\xe2\x84\xaa" in text:
        text = text.replace(b"\xe2\x84\xaa", b"k")
    return text.translate(_FOLD).split()


class _Terms(dict):
    """Word (ASCII bytes) -> number of its stem in ``stems``, 0 for words that the index leaves out (PF3)."""

    def __init__(self):
        self.stems, self.numbers = [""], {}

    def __missing__(self, word: bytes) -> int:
        text, number = word.decode("ascii"), 0
        if len(text) > 1 and text not in _STOP:
            stem = stem_word(text)
            number = self.numbers.setdefault(stem, len(self.stems))
            if number == len(self.stems):
                self.stems.append(stem)
        self[word] = number
        return number


#: The words that this worker has met, in any task.
_known = _Terms()


def _counted(batches: Iterator) -> Iterator:
    """Arrow batches (doc_id, url, domain, title, snippet, content_hash, body, raw title) -> batches of _COUNTED."""
    global _known

    chunk = 0
    for batch in batches:
        *_, bodies, titles = batch.columns
        start, counts, numbers = 0, ([], []), ([], [])
        for i in range(batch.num_rows):
            for texts, n, found in zip((bodies, titles), counts, numbers, strict=True):
                words = _words(texts[i].as_py() or b"")
                found.extend(map(_known.__getitem__, words))
                n.append(len(words))
            if len(numbers[0]) >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield from _chunk(batch.slice(start, i + 1 - start), counts, numbers, _known.stems, chunk)
                chunk += 1
                start, counts, numbers = i + 1, ([], []), ([], [])
                if len(_known) >= KNOWN_WORDS:
                    _known = _Terms()


def _chunk(rows, counts, numbers, stems: list[str], chunk: int) -> Iterator:
    """One chunk of documents, by its number in this task: their rows, and a row for each of their terms."""
    import numpy as np
    import pyarrow as pa

    kinds = dict(zip([c.split()[0] for c in _COUNTED.split(", ")],
                     [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3], strict=True))
    n = rows.num_rows

    def out(size: int, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))

    def differs(values):
        return np.flatnonzero(np.append(True, values[1:] != values[:-1]))

    docs = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    in_title = np.repeat([0, 1], [len(x) for x in numbers])
    terms = np.concatenate([np.array(x, np.int64) for x in numbers])
    kept = terms > 0
    lengths = np.bincount(docs[kept & (in_title == 0)], minlength=n).astype(np.int32)
    display = {c: rows.column(k) for k, c in enumerate(["doc_id", "url", "domain", "title", "snippet", "content_hash"])}
    yield out(n, body_length=pa.array(lengths), **display)
    # every word as one number, sorted by term, document and place: equal ones are counted, neighbours of one document joined
    keys = np.sort(((terms * n + docs) * 2 + in_title)[kept])
    if not len(keys):
        return
    at = differs(keys)
    each, keys = np.diff(np.append(at, len(keys))), keys[at]
    at = differs(keys >> 1)
    tf = [np.add.reduceat(np.where(keys & 1 == place, each, 0), at).astype(np.int32) for place in (0, 1)]
    terms, docs = np.divmod(keys[at] >> 1, n)
    at = differs(terms)
    ends = np.append(at, len(terms)).astype(np.int32)
    lists = [rows.column(0).take(pa.array(docs)), pa.array(tf[0]), pa.array(tf[1]), pa.array(lengths[docs])]
    yield out(len(at), chunk=pa.array(np.full(len(at), chunk, np.int32)), term=pa.array([stems[t] for t in terms[at].tolist()], pa.string()), n_docs=pa.array(np.diff(ends).astype(np.int32)),
              **{c: pa.ListArray.from_arrays(pa.array(ends), x) for c, x in zip(_LISTS, lists, strict=True)})


def count_terms(corpus: DataFrame) -> DataFrame:
    """_COUNTED: every row of ``corpus`` as a stored document, and the postings of these rows in runs, rows of one doc_id still apart."""
    shown = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "url", "domain", _shown_title().alias("title"), _shown_snippet().alias("snippet"),
                          body_hash(F.col("body")).alias("content_hash"), F.col("body").cast("binary").alias("body"),
                          F.col("title").cast("binary").alias("raw_title"))
    return shown.mapInArrow(_counted, _COUNTED)


def counted_documents(counted: DataFrame) -> DataFrame:
    """The stored documents among the rows of ``count_terms``."""
    return counted.filter(F.col("term").isNull()).select("doc_id", "url", "domain", "title", "snippet", "body_length", "content_hash")


def counted_runs(counted: DataFrame) -> DataFrame:
    """(chunk, term, n_docs, doc_ids, tf_body, tf_title, doc_len) of ``count_terms``, which is written: a written table in chunks of whole documents.

    Where several rows have one id, those are added up and all postings are dealt into new chunks by their ids; else the rows are taken as they are.
    """
    runs = counted.filter(F.col("term").isNotNull()).select("chunk", "term", "n_docs", *_LISTS)
    ids = counted.filter(F.col("term").isNull()).select("doc_id")
    twice = materialize(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(F.col("doc_id").alias("twice")))
    if twice.isEmpty():
        return runs
    rows, same = in_rows(runs), F.col("doc_id").eqNullSafe(F.col("twice"))
    single = rows.join(twice, same, "left_anti").unionByName(added_up(rows.join(twice, same, "left_semi")))
    n_postings = runs.agg(F.sum("n_docs")).first()[0] or 0
    return in_chunks(single, "term", _LISTS[1:], max(1, -(-n_postings // CHUNK_WORDS)))


def in_rows(runs: DataFrame, *more: str) -> DataFrame:
    """Runs as postings (term, doc_id, tf_body, tf_title, doc_len); ``more`` names further columns of theirs."""
    each = runs.select("term", *more, *_LISTS[1:], F.posexplode("doc_ids").alias("at", "doc_id"))
    return each.select("term", "doc_id", *[F.get(c, F.col("at")).alias(c) for c in _LISTS[1:]], *more)


def run_frequencies(runs: DataFrame) -> DataFrame:
    """(term, df) of postings in runs."""
    return runs.groupBy("term").agg(F.sum("n_docs").alias("df"))


def stem_table(words: DataFrame, col: str = "word") -> DataFrame:
    """Distinct words of ``words[col]`` with their stems: (word, term)."""
    return add_stem(words.select(F.col(col).alias("word")).distinct(), "word", "term")


def added_up(parts: DataFrame, *more: str) -> DataFrame:
    """``parts`` with one row per term and document; ``more`` names columns that follow from the term."""
    return parts.groupBy(*more, "term", "doc_id").agg(
        F.sum("tf_body").cast("int").alias("tf_body"),
        F.sum("tf_title").cast("int").alias("tf_title"),
        F.max("doc_len").cast("int").alias("doc_len"),
    )


def build_postings(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf_body, tf_title, doc_len) for the kept documents of ``corpus``."""
    return in_rows(counted_runs(materialize(count_terms(corpus))))


def term_table(postings: DataFrame) -> DataFrame:
    """(term, df): the number of documents of every term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _shown_title() -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"), F.lit(""))


def _shown_snippet() -> Column:
    return F.coalesce(F.col("snippet"), F.lit(""))


def build_documents(corpus: DataFrame) -> DataFrame:
    """Stored document rows: title falls back to the url, snippet to '' (PF2)."""
    return corpus.select(
        "doc_id",
        "url",
        "domain",
        _shown_title().alias("title"),
        _shown_snippet().alias("snippet"),
        F.size(index_words(F.col("body"))).cast("int").alias("body_length"),
        body_hash(F.col("body")).alias("content_hash"),
    )


def corpus_stats(documents: DataFrame) -> DataFrame:
    """A5: one row (doc_count, total_length, avg_length); avg is 0 for an empty index."""
    agg = documents.agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.coalesce(F.sum("body_length"), F.lit(0)).cast("long").alias("total_length"),
    )
    return agg.select(
        "doc_count",
        "total_length",
        F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count")).otherwise(F.lit(0.0)).alias(
            "avg_length"
        ),
    )


def build_index(corpus: DataFrame, require_url: bool = True) -> Index:
    kept = corpus.filter(skip_predicate(F.col("url"), F.col("body"), require_url))
    counted = materialize(count_terms(kept))
    documents, runs = counted_documents(counted), counted_runs(counted)
    return Index(documents=documents, postings=in_rows(runs), stats=corpus_stats(documents), terms=run_frequencies(runs), runs=runs)


def index_documents_table(documents_table: DataFrame) -> Index:
    """Index the ``documents`` test table (body only, no url)."""
    return build_index(corpus_from_documents(documents_table), require_url=False)
