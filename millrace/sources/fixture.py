"""The catalogue that the registered queries read: the driver's documents under a catalogue's column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_672_531_200_000  # 2023-01-01 UTC
STEP_MS = 61_000_000
NOW_MS = BASE_MS + 800 * 86_400_000
# Metrics, with the multiplier and modulus that make their numbers.
METRICS = (("view", 7919, 10007), ("like", 104729, 997), ("comment", 1299709, 211), ("banana", 15485863, 53), ("danmaku", 32452843, 401), ("stow", 49979687, 89), ("share", 67867967, 17))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: title (the first line), description (the text), tags, channels, time and seven metrics, some of them null."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    metrics = [F.when(F.col("doc_id") % 13 != i, F.col("doc_id") * p % q).alias(f"{n}_count") for i, (n, p, q) in enumerate(METRICS)]
    return d.select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("payload_title"), F.col("text").alias("payload_description"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("payload_tagList"), F.col("lang").alias("payload_channel_parentName"), F.col("source").alias("payload_channel_name"),
        F.when(F.col("doc_id") % 17 != 0, BASE_MS + F.col("doc_id") % 1000 * STEP_MS).alias("create_ms"), *metrics,
    )


def catalogue_sql() -> str:
    metrics = ", ".join(f"CASE WHEN doc_id % 13 <> {i} THEN doc_id * {p} % {q} END AS {n}_count" for i, (n, p, q) in enumerate(METRICS))
    return f"""cat AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, lang AS tags, lang AS parent, source AS channel,
  CASE WHEN doc_id % 17 <> 0 THEN {BASE_MS} + doc_id % 1000 * {STEP_MS} END AS create_ms, {metrics} FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
