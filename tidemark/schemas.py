"""Declared schemas: stored tables of the engine and the driver's input tables."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# stored index tables
DOCUMENTS = _s(("doc_id", LongType()), ("url", StringType()), ("domain", StringType()), ("title", StringType()),
               ("snippet", StringType()), ("body_length", IntegerType()), ("content_hash", StringType()),
               ("crawled_at", TimestampNTZType()), ("updated_at", TimestampNTZType()))
POSTINGS = _s(("term", StringType()), ("doc_id", LongType()), ("tf_body", IntegerType()),
              ("tf_title", IntegerType()), ("doc_len", IntegerType()))
INDEX_STATS = _s(("doc_count", LongType()), ("total_length", LongType()))

# crawl bookkeeping
CRAWL_QUEUE = _s(("id", LongType()), ("url", StringType()), ("domain", StringType()), ("depth", IntegerType()),
                 ("status", StringType()), ("discovered_at", TimestampType()), ("processed_at", TimestampType()),
                 ("error", StringType()))
DOMAIN_STATS = _s(("domain", StringType()), ("pages_crawled", IntegerType()), ("last_fetched_at", TimestampType()),
                  ("crawl_delay_ms", IntegerType()), ("disallowed", BooleanType()))
ROBOTS_CACHE = _s(("domain", StringType()), ("rules_text", StringType()), ("fetched_at", TimestampType()))
FETCH_LOG = _s(("url", StringType()), ("status", IntegerType()), ("content_type", StringType()),
               ("html", StringType()), ("error", StringType()))
OUTCOME_LOG = _s(("url", StringType()), ("domain", StringType()), ("outcome", StringType()), ("ts", TimestampType()),
                 ("crawl_delay_ms", IntegerType()), ("error", StringType()))

# search history and bookmarks
HISTORY = _s(("history_id", StringType()), ("user_id", StringType()), ("query", StringType()),
             ("ts", TimestampType()))
BOOKMARKS = _s(("user_id", StringType()), ("id", StringType()), ("title", StringType()), ("url", StringType()),
               ("saved_at", TimestampType()))
DICTIONARY_ENTRY = StructType([
    StructField("word", StringType()),
    StructField("phonetic", StringType()),
    StructField("phonetics", ArrayType(StructType([StructField("text", StringType())]))),
    StructField("meanings", ArrayType(StructType([
        StructField("partOfSpeech", StringType()),
        StructField("definitions", ArrayType(StructType([StructField("definition", StringType())]))),
    ]))),
])

# driver input tables used here
INPUT = {
    "documents": _s(("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()),
                    ("n_chars", LongType())),
    "pages": _s(("page_id", LongType()), ("url", StringType()), ("html", StringType())),
    "benchmark": _s(("item_id", LongType()), ("text", StringType())),
    "conversations": _s(("conv_id", LongType()), ("turn", LongType()), ("role", StringType()), ("text", StringType())),
    "events": _s(("event_id", LongType()), ("ts", TimestampNTZType()), ("user_id", LongType()),
                 ("event_type", StringType()), ("value", DoubleType()), ("props", StringType())),
}
