"""From ``documents`` to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as Parquet in the shared folder and reads it
back as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.content_sort import drop_copies
from tidemark.llm.jaccard_join import drop_near_copies
from tidemark.llm.language import UNKNOWN, identify, prototypes
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.staging import staged

#: Best cosine below which a text is no nearer to a learned language than random letters are.
MIN_COSINE = 0.05
#: Distinct n-grams below which a low cosine says nothing: a word or two are about as near to their own language as noise is.
MIN_GRAMS = 32
#: Words that a packing worker keeps encoded: fewer than in a job of its own, as earlier stages leave the workers larger.
PACK_CACHE_WORDS = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or are long enough to tell and near no learned language."""
    learned = prototypes(docs, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text"), learned, grams_col="n_grams")
    return found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= MIN_COSINE) | (F.col("n_grams") < MIN_GRAMS))).select("document.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Copies of a document have their own pieces."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True, cache_words=PACK_CACHE_WORDS)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

#: SQL has no form of the learned language profiles, the tokenizer or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
