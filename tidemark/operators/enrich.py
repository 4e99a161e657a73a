"""Dictionary cards for single-word queries (D1, J10, U2, PF11), over a dictionary table.

The dictionary is a table (word, entry_json) of dictionary API answers (a JSON array of entries); it is
joined to the queries on the word instead of a web call per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType

from tidemark import schemas
from tidemark.functions.text import trim_ws

CARD_URL = "https://dictionary.cambridge.org/dictionary/english/"
CARD_SCORE = 100.0


def single_word(query: Column) -> Column:
    """PF11: the trimmed query is one word of ASCII letters."""
    return trim_ws(query).rlike(r"^[a-zA-Z]+$")


def parse_cards(dictionary: DataFrame) -> DataFrame:
    """(word, id, url, title, snippet, score) for entries with a first definition; others dropped."""
    arr = F.from_json(F.col("entry_json"), ArrayType(schemas.DICTIONARY_ENTRY))
    e = F.get(arr, 0)
    meaning = F.get(e["meanings"], 0)
    definition = F.get(meaning["definitions"], 0)["definition"]
    pos = F.coalesce(meaning["partOfSpeech"], F.lit(""))
    first_ph = F.get(F.filter(e["phonetics"], lambda p: F.coalesce(F.length(p["text"]), F.lit(0)) > 0), 0)["text"]
    phonetic = F.coalesce(F.nullif(e["phonetic"], F.lit("")), first_ph, F.lit(""))
    cards = dictionary.select(
        "word",
        e["word"].alias("entry_word"), definition.alias("definition"), pos.alias("pos"), phonetic.alias("phonetic"),
    ).filter(F.col("definition").isNotNull() & (F.length("definition") > 0))
    return cards.select(
        "word",
        F.concat(F.lit("dict-"), F.col("word")).alias("id"),
        F.concat(F.lit(CARD_URL), F.url_encode(F.col("word"))).alias("url"),
        F.concat(F.col("entry_word"), F.lit(" ("), F.col("pos"), F.lit(") - Definition & Meaning")).alias("title"),
        F.concat(
            F.lit("Definition: "), F.col("definition"),
            F.when(F.length("phonetic") > 0, F.concat(F.lit(" Pronunciation: "), F.col("phonetic"))).otherwise(F.lit("")),
        ).alias("snippet"),
        F.lit(CARD_SCORE).alias("score"),
    )


def cards_for_queries(queries: DataFrame, dictionary: DataFrame, id_col: str = "query_id",
                      text_col: str = "query") -> DataFrame:
    """J10 + U2: one card row (rank 0, not counted in totals) per single-word query with a definition."""
    cards = parse_cards(dictionary)
    q = queries.filter(single_word(F.col(text_col))).select(
        F.col(id_col).alias("query_id"), F.lower(trim_ws(F.col(text_col))).alias("word"))
    return q.join(cards, "word").select(
        "query_id", F.lit(0).alias("rank"), "id", "url", "title", "snippet", "score")


def with_cards(results: DataFrame, cards: DataFrame) -> DataFrame:
    """The card goes first (rank 0) in front of the ranked results; it has no source and counts in no total."""
    return results.unionByName(cards, allowMissingColumns=True)
