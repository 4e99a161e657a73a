"""Readers for the input tables and literal inputs (SC1, SC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """SC1: parquet scan with the declared schema when one exists; ``columns`` prunes at the scan."""
    reader = spark.read
    schema = schemas.INPUT.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    """SC3: a JSON array of urls (one file) -> one row per url, in file order (``pos``)."""
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json(F.col("value"), "array<string>")
    return raw.select(F.posexplode(arr).alias("pos", "url"))


#: Addresses of one seed file, about.
SEEDS_PER_FILE = 10_000


def write_seed_lists(seeds: DataFrame, folder: str, per_file: int = SEEDS_PER_FILE) -> None:
    """Seed files below ``folder``, one JSON array of urls each, for ``read_seed_list``; null urls are left out."""
    rows = seeds.select("url").filter(F.col("url").isNotNull())
    files = max(1, -(-rows.count() // per_file))
    dealt = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.groupBy("part").agg(F.to_json(F.collect_list("url")).alias("value")).write.partitionBy("part").text(folder)
