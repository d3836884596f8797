"""Scans, sinks, column detection, and the vector store kept as a table."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names under which a catalogue's columns are found.
CANDIDATES = {
    "title": ("payload_title", "title"),
    "description": ("payload_description", "description"),
    "tags": ("payload_tagList", "tags"),
    "parent": ("payload_channel_parentName", "parent_channel"),
    "channel": ("payload_channel_name", "channel"),
}


def resolve_column(df: DataFrame, explicit: str | None, candidates: Sequence[str], label: str) -> str:
    """The column that is asked for, else the first candidate there is."""
    for name in [explicit] if explicit else candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {label} column: looked for {explicit or ', '.join(candidates)}")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A pruned Parquet scan; limit takes any rows, as many."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def count_rows(df: DataFrame, limit: int | None = None) -> int:
    return df.count() if limit is None else min(limit, df.limit(limit).count())


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """A pseudo-random sample that is the same each time: the rows with the n smallest MD5 sums of the seed and their ids. Null ids are left out."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    return df.where(F.col(id_column).isNotNull()).orderBy(digest, id_column).limit(n)


def first_per_id(df: DataFrame, id_column: str, order: Sequence) -> DataFrame:
    """One row an id, the first in the order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(id_column).orderBy(*order))).where("_rn = 1").drop("_rn")


def optional_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; nulls are empty cells. single is for reports of a bounded number of rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local master gets a temporary folder where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class VectorStore:
    """Points (id, vector, payload) in a Parquet folder. An upsert replaces the points with its ids; of rows of an id the last wins: of the last ingest, the last in the order of its partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ingest(self, points: DataFrame, recreate: bool = False, skip_existing: bool = False) -> bool:
        """False if the store was there and is skipped, which is tested first; else points are added, after dropping the old ones if recreate."""
        there = self.exists()
        if there and skip_existing:
            return False
        version = 0
        if there and not recreate:
            version = (self.spark.read.parquet(self.path).agg(F.max("version")).first()[0] or 0) + 1
        rows = points.withColumn("version", F.lit(version)).withColumn("place", F.monotonically_increasing_id())
        rows.write.mode("overwrite" if recreate or not there else "append").option("compression", "zstd").parquet(self.path)
        return True

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return first_per_id(rows, "id", [F.desc("version"), F.desc("place")]).drop("version", "place")

    def retrieve(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("id").distinct(), "id", "left_semi")


def joined_points(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Metadata with vectors by id; an id that only one side has is an error when the rows are read."""
    both = metadata.join(vectors.select(F.col("id").alias("_vid"), "vector"), F.col("id") == F.col("_vid"), "full")
    ok = F.when(F.col("id").isNull() | F.col("_vid").isNull(), F.raise_error(F.lit("metadata and vectors have different ids"))).otherwise(F.col("id"))
    return both.withColumn("id", ok).drop("_vid")
