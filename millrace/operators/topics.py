"""Topic search: seeds by text, their centroid, the nearest vectors, metadata. Sparse and dense."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables
from . import features

#: Places of a sparse centroid that is sent to all tasks: 32 MB; larger ones are joined.
MAX_FEATURES = 1 << 22

FIELDS = ("title", "description", "channel", "parent_channel", "tags")


def find_seeds(metadata: DataFrame, query: str, mode: str = "phrase", fields: Sequence[str] = FIELDS, limit: int | None = None, like: bool = False) -> DataFrame:
    """Rows whose fields, joined and lower-cased, match; the first by id if there is a limit."""
    unknown = set(fields) - set(FIELDS)
    if unknown or not fields:
        raise ValueError(f"unknown seed fields: {', '.join(sorted(unknown)) or 'none given'}")
    phrase, terms = T.normalize_query(query)
    hay = T.haystack([F.col(f) for f in FIELDS if f in fields], " \n ")
    seeds = metadata.where(T.matches(hay, phrase, terms, mode, like))
    return seeds if limit is None else seeds.orderBy("id").limit(limit)


# Dense vectors


def dense_centroid(vectors: DataFrame, seeds: DataFrame, dimensions: int) -> DataFrame:
    """One row: seed_count and vector, the mean by position over the seeds' vectors (a repeated seed counts again). Nulls in a vector are left out of its mean."""
    matched = vectors.select("id", "vector").join(seeds.select("id"), "id")
    means = [F.avg(F.get("vector", i).cast("double")).cast("float") for i in range(dimensions)]
    return matched.agg(F.count(F.lit(1)).alias("seed_count"), F.array(*means).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector; vectors of unequal lengths are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal lengths")).cast("double"))
    return F.coalesce(same, F.when(norms > 0, dot(a, b) / norms))


def nearest(vectors: DataFrame, centroid: DataFrame, top_k: int, min_score: float, exclude: DataFrame | None = None) -> DataFrame:
    """id, score of the top_k by cosine, then id; the centroid is one row, sent to all tasks."""
    rows = vectors.select("id", "vector")
    if exclude is not None:
        rows = rows.join(exclude.select("id").distinct(), "id", "left_anti")
    scored = rows.crossJoin(F.broadcast(centroid.select(F.col("vector").alias("_c")))).select("id", cosine(F.col("vector"), F.col("_c")).alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)


def build_centroid(metadata: DataFrame, vectors: DataFrame, query: str, mode: str = "phrase", seed_limit: int | None = None, dimensions: int = 128, like: bool = False) -> tuple[DataFrame, DataFrame]:
    """The centroid table (query, phrase, term_mode, seed_count, vector), one row, and the seeds."""
    seeds = find_seeds(metadata, query, mode, limit=seed_limit, like=like)
    phrase, _ = T.normalize_query(query)
    c = dense_centroid(vectors, seeds, dimensions)
    return c.select(F.lit(query).alias("query"), F.lit(phrase).alias("phrase"), F.lit(mode).alias("term_mode"), "seed_count", "vector"), seeds


def query_centroid(metadata: DataFrame, vectors: DataFrame, centroid: DataFrame, top_k: int = 1000, min_score: float = 0.0, seeds: DataFrame | None = None, exclude_seeds: bool = False) -> DataFrame:
    """Hits with metadata (an inner join) and what the centroid says of itself."""
    if exclude_seeds and seeds is None:
        raise ValueError("seeds are needed to be excluded")
    known = vectors.join(metadata.select("id").distinct(), "id", "left_semi")
    top = nearest(known, centroid, top_k, min_score, seeds if exclude_seeds else None)
    said = centroid.select("query", "phrase", "term_mode", "seed_count")
    return top.crossJoin(F.broadcast(said)).join(metadata, "id").select(*said.columns, "id", "score", *(c for c in metadata.columns if c != "id")).orderBy(F.desc(F.round("score", 9)), "id")


def dense_topic(metadata: DataFrame, vectors: DataFrame, query: str, mode: str = "phrase", seed_limit: int | None = None, top_k: int = 1000, min_score: float = 0.0, exclude_seeds: bool = False, dimensions: int = 128) -> DataFrame:
    centroid, seeds = build_centroid(metadata, vectors, query, mode, seed_limit, dimensions)
    return query_centroid(metadata, vectors, centroid, top_k, min_score, seeds, exclude_seeds)


def seed_preview(metadata: DataFrame, vectors: DataFrame, centroid: DataFrame, seeds: DataFrame, n: int = 5) -> DataFrame:
    mine = vectors.join(seeds.select("id").distinct(), "id", "left_semi")
    return nearest(mine, centroid, n, float("-inf")).join(metadata, "id").orderBy(F.desc(F.round("score", 9)), "id")


# Sparse vectors


def sparse_centroid(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """idx, weight: the mean over the seeds that have a vector, of unit length. No seed, or a zero mean, is an error when it is read."""
    matched = vectors.join(seeds.select("id").distinct(), "id", "left_semi")
    sums = features.unpack(matched).groupBy("idx").agg(F.sum("val").alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy()))
    return sums.select("idx", F.when(norm > 0, F.col("s") / norm).otherwise(F.raise_error(F.lit("the centroid is zero")).cast("double")).alias("weight"))


def sparse_dot(weights: np.ndarray, indices: np.ndarray, values: np.ndarray) -> float:
    known = indices < len(weights)
    return float(weights[indices[known]] @ values[known])


def dense_weights(centroid: DataFrame) -> np.ndarray | None:
    """The centroid by index, if it has at most MAX_FEATURES places (8 bytes each), to be sent to all tasks."""
    size = centroid.agg(F.max("idx")).first()[0]
    if size is None or size >= MAX_FEATURES:
        return None
    out = np.zeros(size + 1)
    for idx, weight in centroid.select("idx", "weight").collect():
        out[idx] = weight
    return out


def sparse_nearest(vectors: DataFrame, centroid: DataFrame, top_k: int, min_score: float, exclude: DataFrame | None = None) -> DataFrame:
    """id, score: dot products with the centroid, the top_k by score, then id, both descending. Indices the centroid lacks count 0."""
    rows = vectors.where(F.size("vector.indices") > 0)
    if exclude is not None:
        rows = rows.join(exclude.select("id").distinct(), "id", "left_anti")
    dense = dense_weights(centroid)
    if dense is None:
        scored = features.unpack(rows).join(centroid, "idx", "left").groupBy("id").agg(F.sum(F.coalesce(F.col("weight") * F.col("val"), F.lit(0.0))).alias("score"))
    else:
        sent = vectors.sparkSession.sparkContext.broadcast(dense)

        @F.pandas_udf("double")
        def dot(indices: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([sparse_dot(sent.value, np.asarray(i, np.int64), np.asarray(v, np.float64)) for i, v in zip(indices, values, strict=True)])

        scored = rows.select("id", dot("vector.indices", "vector.values").alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc(F.round("score", 9)), F.desc("id")).limit(top_k)


def sparse_topic(metadata: DataFrame, vectors: DataFrame, query: str, mode: str = "phrase", seed_limit: int | None = 20_000, top_k: int = 100, min_score: float = 0.15, exclude_seeds: bool = False, seed_fields: Sequence[str] = FIELDS) -> DataFrame:
    """rank, id, score and metadata, which may be missing. Seeds are excluded before the limit, so top_k rows are given if there are as many."""
    seeds = find_seeds(metadata, query, mode, seed_fields, seed_limit)
    top = sparse_nearest(vectors, sparse_centroid(vectors, seeds), top_k, min_score, seeds if exclude_seeds else None)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), F.desc("id"))).cast("long"))  # over top_k rows
    # Of metadata rows that repeat an id, the last by its fields; only ids among the hits are looked at.
    named = tables.first_per_id(metadata.select("id", *FIELDS).join(F.broadcast(top.select("id")), "id", "left_semi"), "id", [F.desc(f) for f in FIELDS])
    return ranked.join(named, "id", "left").select("rank", "id", "score", *FIELDS).orderBy("rank")
