"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.staging import new_folder
    from tidemark.llm.warc import hex_digest, page_of, read_warc, write_warc

    folder = new_folder(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), folder)
    read = read_warc(spark, folder)
    response = F.col("record_type") == "response"
    return read.select(
        page_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(hex_digest(F.col("payload_digest"))).alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"))


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import digests, format_conversations, read_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(read_conversations(format_conversations(turns.unionByName(planted))))


def _remainder(divisor: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % divisor


def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    return score(docs, machine).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hash_search import search

    return search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), asked=F.col("vec_id") % 20 == 0)


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.content_sort import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify, prototypes

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = prototypes(docs, learn=_remainder(4) != 2)
    out = identify(docs, learned, keep=["doc_id"])
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.staging import new_folder
    from tidemark.llm.token_files import read_token_files, write_token_files

    folder = new_folder(spark, "tokens")
    index = write_token_files(_table(spark, sf_dir, "documents"), folder, _vocabulary("word_bpe_49k.json"), added_tokens=True)
    read = read_token_files(spark, folder, index)
    return read.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack, token_pieces

    pieces = token_pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), added_tokens=True)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op11_batch_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.importance import resample

    out = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 h is divisible by 10: from word a on, their words repeat with period p."""
    from tidemark.llm.words import WORD

    h = F.crc32(F.col("doc_id").cast("string"))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words").cast("long")
    found = found.select("doc_id", "text", "words", n.alias("n"), "g", F.when(n > 0, F.col("g") % n).alias("a"))
    found = found.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1),
                       lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return found.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_descending_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periodic import periodic_runs

    found = periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs are in order of start, then period: only a greater exponent replaces the best so far
    best = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda kept, r: F.when(r["length"] * kept["period"] > kept["length"] * r["period"], r).otherwise(kept))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_warc, op2_pareto_mixing, op3_chat_round_trip, op4_factorization_machine, op5_multi_index_hashing, op6_content_sort, op7_wavelet_files, op8_hyperdimensional, op9_sum_of_squares, op10_bayes_jaccard,
                            op11_batch_concatenation, op12_descending_lcp, op13_diagonal_voting)
}
