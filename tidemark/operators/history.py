"""Search history and bookmarks as tables (H1-H4, W4, T8, J8, SC8, PF12, U3).

history (history_id, user_id, query, ts); bookmarks (user_id, id, title, url, saved_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_ci, trim_ws

RECENT = 3


def append(history: DataFrame, searches: DataFrame) -> DataFrame:
    """H1: add (history_id, user_id, query, ts) rows of new searches (batch form of the log append)."""
    return history.unionByName(searches.select("history_id", "user_id", "query", "ts"))


def recent_queries(history: DataFrame, n: int = RECENT) -> DataFrame:
    """Per user, the ``n`` most recently used distinct queries (newest first).

    Distinct (user, query) first (partial aggregate), then a top-n window per user with a map-side group
    limit, so a very active user is reduced before the shuffle."""
    last = history.groupBy("user_id", "query").agg(F.max("ts").alias("last_ts"))
    w = Window.partitionBy("user_id").orderBy(F.col("last_ts").desc(), F.col("query").asc())
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "user_id", F.col("rank").cast("int").alias("rank"), "query", "last_ts")


def suggestions(history: DataFrame, inputs: DataFrame, n: int = RECENT) -> DataFrame:
    """For each (user_id, input), the ``n`` newest distinct history queries of that user that
    contain the trimmed input, case-insensitively. Inputs join history on user (equi-join)."""
    j = inputs.join(history, "user_id").filter(contains_ci(F.col("query"), F.col("input")))
    last = j.groupBy("user_id", "input", "query").agg(F.max("ts").alias("last_ts"))
    w = Window.partitionBy("user_id", "input").orderBy(F.col("last_ts").desc(), F.col("query").asc())
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "user_id", "input", F.col("rank").cast("int").alias("rank"), "query")


def trigram_postings(history: DataFrame) -> DataFrame:
    """H3 index: (user_id, gram, query, last_ts), one row per user, distinct query and distinct run of three of its letters in lower case."""
    last = history.groupBy("user_id", "query").agg(F.max("ts").alias("last_ts"))
    return last.select("user_id", "query", "last_ts", F.explode(_trigrams(F.lower("query"))).alias("gram"))


def _trigrams(text):
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(3))))


def indexed_suggestions(history: DataFrame, postings: DataFrame, inputs: DataFrame, n: int = RECENT) -> DataFrame:
    """``suggestions`` through ``trigram_postings``: queries that hold every trigram of an input are candidates, then tested with contains.

    An input of one or two letters has no trigram and is compared with its user's distinct queries; an empty one matches them all."""
    asked = inputs.select("user_id", "input").distinct().withColumn("needle", F.lower(trim_ws(F.col("input"))))
    grams = asked.filter(F.length("needle") >= 3).select("user_id", "input", "needle", F.size(_trigrams(F.col("needle"))).alias("n_grams"),
                                                         F.explode(_trigrams(F.col("needle"))).alias("gram"))
    held = grams.join(postings, ["user_id", "gram"]).groupBy("user_id", "input", "needle", "n_grams", "query").agg(
        F.count(F.lit(1)).alias("n"), F.max("last_ts").alias("last_ts")).filter(F.col("n") == F.col("n_grams"))
    last = history.groupBy("user_id", "query").agg(F.max("ts").alias("last_ts"))
    short = asked.filter(F.length("needle") < 3).join(last, "user_id")
    columns = ["user_id", "input", "needle", "query", "last_ts"]
    found = held.select(columns).unionByName(short.select(columns)).filter(F.contains(F.lower("query"), F.col("needle")))
    w = Window.partitionBy("user_id", "input").orderBy(F.col("last_ts").desc(), F.col("query").asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "user_id", "input", F.col("rank").cast("int").alias("rank"), "query")


def append_stream(searches: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """H1 as a sink: a stream of (history_id, user_id, query, ts) appended below ``path``; returns the StreamingQuery.

    A micro-batch has a folder of its own, named by its id, so a batch replayed after a failure replaces what it wrote before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("history_id", "user_id", "query", "ts").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    writer = searches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def bookmark_flags(results: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Add ``bookmarked`` = whether (user_id, id) is among the user's bookmarks (existence join)."""
    marks = bookmarks.select("user_id", "id").distinct().withColumn("_hit", F.lit(True))
    return results.join(marks, ["user_id", "id"], "left").withColumn(
        "bookmarked", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def delete_items(history: DataFrame, ids: DataFrame) -> DataFrame:
    """PF12: drop history rows by id."""
    return history.join(ids.select("history_id"), "history_id", "left_anti")


def export_backup(history: DataFrame, path: str, users: DataFrame | None = None) -> None:
    """SC8 export: one user's (or some users') history as JSON lines."""
    out = history if users is None else history.join(users.select("user_id"), "user_id", "left_semi")
    out.write.mode("overwrite").json(path)


def read_backup(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: What a user's backup holds; each kind is a table with a user_id.
BACKUP_KINDS = ["settings", "history", "bookmarks", "shortcuts"]


def export_user_data(tables: dict[str, DataFrame], path: str, users: DataFrame | None = None) -> None:
    """SC8 export of everything: each kind of ``tables`` as JSON lines in a folder of its own; of all users, or of ``users`` (user_id)."""
    for kind in BACKUP_KINDS:
        export_backup(tables[kind], f"{path.rstrip('/')}/{kind}", users)


def restore_user_data(tables: dict[str, DataFrame], path: str, targets: DataFrame) -> dict[str, DataFrame]:
    """SC8 restore of everything from ``export_user_data``'s folders: per kind, the rows of every user_id in ``targets`` are replaced by
    the exported rows of its source_user, and all other rows stay. A user without exported rows of a kind keeps none of it."""
    return {kind: restore_each(tables[kind], read_backup(tables[kind].sparkSession, f"{path.rstrip('/')}/{kind}", tables[kind].schema), targets)
            for kind in BACKUP_KINDS}


def restore(current: DataFrame, imported: DataFrame, target_user) -> DataFrame:
    """SC8 restore / U3: the target user's rows are replaced by all imported rows, re-keyed to that user; other users' rows are
    untouched. ``imported`` may come from any user. An empty import leaves the user without rows."""
    keep = current.join(_user(current, target_user), "user_id", "left_anti")
    rekeyed = imported.withColumn("user_id", F.lit(target_user).cast(current.schema["user_id"].dataType))
    return keep.unionByName(rekeyed.select(*current.columns))


def restore_each(current: DataFrame, imported: DataFrame, targets: DataFrame) -> DataFrame:
    """``restore`` for many users at once: ``targets`` has source_user (whose rows were exported) and user_id (who takes them)."""
    keep = current.join(targets.select("user_id").distinct(), "user_id", "left_anti")
    rows = imported.withColumnRenamed("user_id", "source_user").join(targets, "source_user")
    return keep.unionByName(rows.select(*current.columns))


def _user(current: DataFrame, user) -> DataFrame:
    return current.sparkSession.range(1).select(F.lit(user).cast(current.schema["user_id"].dataType).alias("user_id"))
