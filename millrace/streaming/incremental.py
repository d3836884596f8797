"""An extension: keep a BM25 index up to date from a stream of new catalogue files.

Each micro-batch is tokenised, its postings and lengths are appended, and the term statistics are
written again from all postings, last of all, under the batch's epoch; readers take the largest epoch that
has statistics. A batch that is run again replaces what it wrote before, as its rows lie in a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import bm25


def append(path: str):
    """A foreachBatch function."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        index = bm25.build(bm25.base_table(batch))
        for name, df in (("base", index.base), ("postings", index.postings), ("doc_stats", index.doc_stats)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
        bm25.term_statistics(spark.read.parquet(f"{path}/postings").drop("epoch")).write.mode("overwrite").parquet(f"{path}/term_stats/epoch={epoch}")

    return run


def load(spark: SparkSession, path: str) -> bm25.Index:
    """The index as of the last epoch that has statistics; rows of a batch that failed before them aren't read."""
    stats = spark.read.parquet(f"{path}/term_stats")
    last = stats.agg(F.max("epoch")).first()[0]
    read = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("epoch") <= last).drop("epoch")
    return bm25.Index(read("base"), read("postings"), read("doc_stats"), stats.where(F.col("epoch") == last).drop("epoch"))


def follow(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, once: bool = True):
    """Starts the stream over Parquet files in source; once: what is there now, then it ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(append(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
