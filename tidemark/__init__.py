"""tidemark: page-corpus indexing, BM25 search and crawl bookkeeping as Spark DataFrame jobs.

Layout
    functions/  Column -> Column building blocks (tokens, stemmer, BM25 maths, URLs, HTML)
    operators/  DataFrame -> DataFrame jobs (index build, ranking, re-index, frontier, robots, history)
    sources/    table readers, literal inputs, versioned index sink, JSON response sink
    plans/      end-to-end plans that chain operators (search over a table, crawl-and-index)
    streaming/  Structured Streaming ingest (micro-batch re-index)
"""

from tidemark.session import get_spark

__all__ = ["get_spark"]
