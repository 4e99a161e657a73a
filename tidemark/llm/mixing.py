"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the expected number of copies of each of its documents. The whole part
is taken for certain; for the rest, documents are ranked by the odds of a uniform draw over their inclusion
odds, and the front of that order is taken up to the words still missing. The draw is a hash of the
identifier, so reruns agree. The cut is found from word sums over quantile buckets of the rank value, and
only the one bucket that holds the cut is ordered, so no source ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged
from tidemark.llm.words import n_words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
BUCKETS = 65536
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``total_share`` of all sizes; a
    target stops at ``max_copies`` times its source, and the excess goes to the others by weight. Capped sources
    are those with the least room per weight, so running sums in that order give the final share at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    per = per.withColumn("at", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(every) * F.lit(float(total_share))
                         - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", F.col("left") / F.col("left_weight"))
    per = per.withColumn("capped", F.col("cap") <= F.col("share") * F.col("weight"))
    # the first source that stays below its cap fixes the share of all that follow it
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "at", "share"))).over(every)["share"]
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    return per.select("source", "source_size", "target")


def _draw(id_col: Column) -> Column:
    """A number in (0, 1) from the identifier: 52 bits of a digest."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), id_col.cast("string"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def _plan(rows: DataFrame, **targets) -> DataFrame:
    """Per source: source, source_size, target, whole, chance and the last rank value, id and size that the mix takes."""
    per = source_targets(rows, **targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.col("whole"))
    per = staged(per.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")

    ranked = ranked_rows(rows, per)
    drawn = ranked.where("chance > 0")
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(upto)).withColumn("from", F.col("upto") - F.col("words"))
    cut = sums.where(F.col("upto") >= F.col("missing")).groupBy("source").agg(F.min(F.struct("bucket", "from")).alias("cut"))
    cut = staged(cut.select("source", "cut.*"), "mix-cuts")

    inside = drawn.join(cut, (drawn["source"].eqNullSafe(cut["source"])) & (drawn["bucket"] == cut["bucket"])).select(
        drawn["source"], "rank_value", "id", "size", "missing", "from")
    order = Window.partitionBy("source").orderBy("rank_value", F.asc_nulls_last("id"), "size")
    # the default frame counts equal rows together, so they are taken together
    inside = inside.withColumn("middle", F.col("from") + F.sum("size").over(order) - F.col("size") / 2)
    last = inside.where(F.col("middle") <= F.col("missing")).groupBy("source").agg(
        F.max(F.struct("rank_value", F.col("id").isNull().alias("no_id"), "id", "size")).alias("last"))
    cut = cut.withColumnRenamed("source", "cut_source")
    last = last.withColumnRenamed("source", "last_source")
    out = per.join(cut, per["source"].eqNullSafe(cut["cut_source"]), "left").join(
        last, per["source"].eqNullSafe(last["last_source"]), "left")
    return staged(out.select("source", "source_size", "target", "whole", "chance", "missing",
                             F.col("bucket").alias("cut_bucket"), "last"), "mix-plan")


def ranked_rows(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (source, id, size and others) with their source's plan, rank value and its bucket."""
    named = per.withColumnRenamed("source", "plan_source")
    out = rows.join(named, rows["source"].eqNullSafe(named["plan_source"])).drop("plan_source")
    odds = F.col("draw") / (1 - F.col("draw"))
    chance = F.when((F.col("chance") > 0) & (F.col("chance") < 1), F.col("chance")).otherwise(F.lit(0.5))
    out = out.withColumn("draw", _draw(F.col("id"))).withColumn("rank_value", odds / (chance / (1 - chance))).drop("draw")
    return out.withColumn("bucket", F.floor(F.col("rank_value") / (1 + F.col("rank_value")) * BUCKETS).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, **targets) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, copies (0 to ``max_copies``).

    With ``carry`` a struct column ``row`` holds the input row. A null text has size 0; null is a source of its own,
    the last; a null identifier is drawn like any other and ranks after its ties. Repeated rows share their
    draw. Documents of size 0 get their source's copies and take no words. A source without words has target
    0 and no copies. An empty table gives an empty result.
    """
    base = [F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"),
            n_words(F.col(f"`{text_col}`")).alias("size")]
    rows = docs.select(*base)
    if not carry:
        rows = staged(rows, "mix-sizes")
        again = rows
    else:
        again = docs.select(*base, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        rows = staged(rows, "mix-sizes")
    out = ranked_rows(again, _plan(rows, **targets))
    own = F.struct("rank_value", F.col("id").isNull().alias("no_id"), "id", "size")
    front = (F.col("chance") > 0) & F.coalesce(
        F.when(F.col("cut_bucket").isNull(), F.lit(True)).when(F.col("bucket") != F.col("cut_bucket"), F.col("bucket") < F.col("cut_bucket"))
        .otherwise(own <= F.col("last")), F.lit(False))
    copies = (F.col("whole") + front.cast("int")).cast("int")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of ``docs``, each row as often as the mix takes it."""
    out = mix(docs, carry=True, **options).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
