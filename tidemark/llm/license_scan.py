"""License scans by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined to the positions where a template holds that gram (the grams
themselves are compared too, so a hit is never a hash collision). A hit votes for its diagonal, the document position less the
template position. A phrase stands where one diagonal has a vote from each of its grams. A longer notice may have lost or gained
words, which moves the rest of it to a near diagonal: neighbouring diagonals are merged into spans, and a span counts if enough of the
template's grams, each once, are found in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged
from tidemark.llm.words import text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM_WORDS = 2
#: Diagonals at most this far apart belong to one span of a notice.
SLACK = 4
#: Share of a notice's grams that a span has to hold; a notice of fewer than WHOLE_GRAMS has to be there whole, as one word may make another license.
COVERAGE = 0.8
WHOLE_GRAMS = 20

# Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# The opening words of public license notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else; a text of ASCII bytes alone needs no table."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def scan_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """(pos, gram) of all k-grams of a word array; none if it is shorter."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram")))


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int = GRAM_WORDS) -> DataFrame:
    """(template, label, phrase, n_grams, tpos, gram, gram_hash), written out so that the planner knows its size."""
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases, *notices])]
    templates = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").withColumn("words", scan_words(F.col("text")))
    if templates.where(F.size("words") < k).head(1):
        raise ValueError(f"a template has fewer than {k} words")
    found = templates.select("template", "label", "phrase", (F.size("words") - k + 1).cast("long").alias("n_grams"), F.explode(_grams(F.col("words"), k)).alias("g"))
    return staged(found.select("template", "label", "phrase", "n_grams", F.col("g.pos").alias("tpos"), F.col("g.gram").alias("tgram"),
                               F.xxhash64("g.gram").alias("gram_hash")), "license-grams")


def gram_hits(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, k: int = GRAM_WORDS) -> DataFrame:
    """Per row of ``docs`` one row with n_words and no template, and one row per k-gram position that a template shares."""
    read = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_col}`").alias("id"), scan_words(F.col(f"`{text_col}`")).alias("words"))
    head = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram"))
    rolled = read.select("place", "id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.array(head), _grams(F.col("words"), k))).alias("g"))
    rolled = rolled.select("place", F.when(F.col("g.pos") < 0, F.col("id")).alias("id"), F.when(F.col("g.pos") < 0, F.col("n_words")).alias("n_words"),
                           F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("gram_hash"))
    same = (rolled["gram_hash"] == grams["gram_hash"]) & (rolled["gram"] == grams["tgram"])
    hits = rolled.join(grams, same, "left").where((F.col("pos") < 0) | F.col("template").isNotNull())
    # written once: the row numbers are those of this one run
    return staged(hits.select("place", "id", "n_words", "template", "label", "phrase", "n_grams", F.col("pos").cast("long").alias("pos"),
                              (F.col("pos") - F.col("tpos")).cast("long").alias("diagonal"), "tpos"), "license-hits")


def _needed(coverage: float) -> Column:
    return F.when(F.col("n_grams") < WHOLE_GRAMS, F.col("n_grams").cast("double")).otherwise(F.lit(coverage) * F.col("n_grams"))


def license_spans(hits: DataFrame, slack: int = SLACK, coverage: float = COVERAGE, k: int = GRAM_WORDS) -> DataFrame:
    """(place, label, phrase, first, last, share): verified spans, first and last word, and the share of the template's grams there."""
    votes = hits.where(F.col("template").isNotNull()).groupBy("place", "template", "label", "phrase", "n_grams", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    exact = votes.where(F.col("phrase") & (F.col("votes") == F.col("n_grams")))
    exact = exact.select("place", "label", "phrase", "first", (F.col("last") + k - 1).alias("last"), F.lit(1.0).alias("share"))

    own = Window.partitionBy("place", "template").orderBy("diagonal")
    steps = votes.where(~F.col("phrase")).withColumn("new", F.col("diagonal") - F.lag("diagonal").over(own) > slack)
    spans = steps.withColumn("span", F.count_if("new").over(own)).groupBy("place", "template", "span").agg(
        F.sum("votes").alias("votes"), F.max("n_grams").alias("n_grams"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    spans = spans.where(F.col("votes") >= _needed(coverage)).drop("votes", "n_grams")
    # verification: each gram of the template counts once in a span
    inside = hits.where(~F.col("phrase")).join(spans, ["place", "template"]).where(F.col("diagonal").between(F.col("low"), F.col("high")))
    found = inside.groupBy("place", "label", "phrase", "template", "span", "n_grams").agg(
        F.count_distinct("tpos").alias("held"), F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"))
    found = found.where(F.col("held") >= _needed(coverage))
    return exact.unionByName(found.select("place", "label", "phrase", "first", "last", (F.col("held") / F.col("n_grams")).alias("share")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES,
                  notices: list[tuple[str, str]] = NOTICES, slack: int = SLACK, coverage: float = COVERAGE, k: int = GRAM_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (null without one).
    base_labels are the phrases' labels, labels those of phrases and notices: distinct, sorted, joined by commas, empty without one.
    score is the largest share of a template's grams in one of its spans: 1 for a phrase, 0 without a span. Null and empty texts have
    no word. Rows are told apart by their place, so null identifiers and repeated rows give their own rows; an empty table gives
    none. Other columns are ignored. A long text's grams are spread over the join; only its votes for one template meet.
    """
    hits = gram_hits(docs, template_grams(docs.sparkSession, phrases, notices, k), id_col, text_col, k)
    spans = license_spans(hits, slack, coverage, k).withColumns({"id": F.lit(None).cast(hits.schema["id"].dataType), "n_words": F.lit(None).cast("long")})
    rows = hits.where(F.col("pos") < 0).select("place", "id", "n_words").unionByName(spans, allowMissingColumns=True)
    sorted_set = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    out = rows.groupBy("place").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        sorted_set(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), sorted_set("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
