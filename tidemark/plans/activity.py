"""Search-history scenario derived from the ``events`` table (H1-H4, SC8, D1, J10, U2).

Each event is a search by its user: the query text is the event type followed by the ``k`` number of its
properties (``click 69``); ``purchase`` events bookmark the result ``idx-<floor(value)>``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import enrich, history
from tidemark.session import ensure_checkpoint_dir

RESTORE_SHIFT_DAYS = 7

# Dictionary answers used by the card join, one JSON document per word (the dictionary API's shape).
DICTIONARY_JSON = {
    "click": '[{"word":"click","phonetic":"/klɪk/","phonetics":[{"text":"/klɪk/"}],'
             '"meanings":[{"partOfSpeech":"verb","definitions":[{"definition":"To press a mouse button."}]}]}]',
    "view": '[{"word":"view","phonetic":"","phonetics":[{"text":""},{"text":"/vjuː/"}],'
            '"meanings":[{"partOfSpeech":"noun","definitions":[{"definition":"The act of seeing."}]}]}]',
    "purchase": '[{"word":"purchase","phonetics":[],'
                '"meanings":[{"partOfSpeech":"verb","definitions":[{"definition":"To buy."}]}]}]',
    "signup": '[{"word":"signup","meanings":[]}]',
}


def history_table(events: DataFrame) -> DataFrame:
    k = F.regexp_extract(F.col("props"), r'"k": ?([0-9]+)', 1)
    return events.select(
        F.col("event_id").cast("string").alias("history_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("event_type"), F.lit(" "), k).alias("query"),
        F.col("ts"),
    )


def bookmarks_table(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("idx-"), F.floor("value").cast("long").cast("string")).alias("id"),
    ).distinct()


def shown_results(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("idx-"), F.floor("value").cast("long").cast("string")).alias("id"),
    )


def suggestion_inputs(events: DataFrame) -> DataFrame:
    """Per user, the first three letters of the type of their first event, in upper case with blanks."""
    first = events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("t"))
    return first.select(F.col("user_id").cast("string").alias("user_id"),
                        F.concat(F.lit(" "), F.upper(F.substring("t", 1, 3)), F.lit(" ")).alias("input"))


def restore_scenario(events: DataFrame) -> DataFrame:
    """Users whose id ends in 0 restore a backup of the next user's history, a week older."""
    h = history_table(events)
    targets = h.filter(F.col("user_id").endswith("0")).select("user_id").distinct().withColumn(
        "source_user", (F.col("user_id").cast("long") + 1).cast("string"))
    backup = h.withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(RESTORE_SHIFT_DAYS))).withColumn(
        "history_id", F.concat(F.lit("r"), F.col("history_id")))
    return history.restore_each(h, backup, targets)


def edit_scenario(events: DataFrame) -> DataFrame:
    """Purchases are appended to the other searches (H1); then every seventh event's row is deleted (PF12)."""
    h = history_table(events).join(events.select(F.col("event_id").cast("string").alias("history_id"), "event_type"), "history_id")
    first = h.filter(F.col("event_type") != "purchase").select("history_id", "user_id", "query", "ts")
    added = history.append(first, h.filter(F.col("event_type") == "purchase"))
    gone = events.filter(F.pmod("event_id", F.lit(7)) == 0).select(F.col("event_id").cast("string").alias("history_id"))
    return history.delete_items(added, gone)


def dictionary_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DICTIONARY_JSON.items()), "word string, entry_json string")


def dictionary_cards(spark: SparkSession, events: DataFrame) -> DataFrame:
    queries = events.select(F.col("event_id").alias("query_id"), F.col("event_type").alias("query"))
    return enrich.cards_for_queries(queries, dictionary_table(spark))


def user_tables(events: DataFrame) -> dict[str, DataFrame]:
    """All that a user has: history and bookmarks as above, one settings row a user, a shortcut per sign-up."""
    user = F.col("user_id").cast("string").alias("user_id")
    settings = events.groupBy("user_id").agg(F.max("event_type").alias("theme"), F.count(F.lit(1)).alias("results_per_page")).select(user, "theme", "results_per_page")
    shortcuts = events.filter(F.col("event_type") == "signup").select(
        user, F.concat(F.lit("s"), F.col("event_id")).alias("shortcut_id"), F.concat(F.lit("https://short.test/"), F.floor("value").cast("long")).alias("url"))
    return {"settings": settings, "history": history_table(events), "bookmarks": bookmarks_table(events), "shortcuts": shortcuts}


def backup_scenario(events: DataFrame) -> DataFrame:
    """Users whose id ends in 0 restore the next user's whole backup, which went through JSON files; all tables as (kind, user_id, item)."""
    tables = user_tables(events)
    targets = tables["settings"].filter(F.col("user_id").endswith("0")).select(
        "user_id", (F.col("user_id").cast("long") + 1).cast("string").alias("source_user"))
    path = f"{ensure_checkpoint_dir(events.sparkSession).rstrip('/')}/backup-{uuid.uuid4().hex}"
    history.export_user_data(tables, path, targets.select(F.col("source_user").alias("user_id")))
    out = None
    for kind, table in history.restore_user_data(tables, path, targets).items():
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in table.columns if c not in ("user_id", "ts")])
        rows = table.select(F.lit(kind).alias("kind"), "user_id", item.alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


def logged_history(events: DataFrame) -> DataFrame:
    """H1: the searches arrive as files and are appended by a stream; the log read back."""
    spark = events.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    rows = history_table(events)
    rows.repartition(4).write.parquet(f"{root}/arrivals")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/arrivals")
    stream = history.append_stream(arriving, f"{root}/log", f"{root}/checkpoint")
    stream.awaitTermination()
    if stream.exception() is not None:
        raise RuntimeError(str(stream.exception()))
    return spark.read.schema(rows.schema).parquet(f"{root}/log").select(*rows.columns)


def benchmark_dictionary(benchmark: DataFrame) -> DataFrame:
    """A dictionary of the benchmark items' first words, as the dictionary API answers: the text's start defines the word."""
    words = benchmark.select("item_id", "text", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("word")).filter(F.length("word") > 0)
    first = words.groupBy("word").agg(F.min(F.struct("item_id", "text")).alias("r"))
    even = F.pmod("r.item_id", F.lit(2)) == 0
    entry = F.struct(
        "word", F.when(even, F.concat(F.lit("/"), F.col("word"), F.lit("/"))).otherwise(F.lit("")).alias("phonetic"),
        F.array(F.struct(F.lit("").alias("text")), F.struct(F.concat(F.lit("~"), F.col("word")).alias("text"))).alias("phonetics"),
        F.array(F.struct(F.lit("noun").alias("partOfSpeech"), F.array(F.struct(F.substring("r.text", 1, 60).alias("definition"))).alias("definitions"))).alias("meanings"))
    return first.select("word", F.to_json(F.array(entry)).alias("entry_json"))


def word_cards(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document's first word is looked up."""
    queries = documents.select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("query"))
    return enrich.cards_for_queries(queries, benchmark_dictionary(benchmark))
