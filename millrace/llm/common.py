"""What several corpus operators share: words, the shared folder, materialising, column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none. Lone surrogates are kept as they are."""
    return [] if text is None else utf8(text).split()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_count(text: Column) -> Column:
    """The number of words, JVM-side; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master gets a temporary one where none is set; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, as the worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shorten_batches(spark: SparkSession, rows: int = 2000) -> None:
    """short_batches for all that the session does from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of fewer rows while a table is written: texts are long, and a worker holds a batch more than once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one job in the shared folder: Parquet, so they outlive lost executors, and gone when the result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.tables = spark, fresh_path(spark, name), []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        path = f"{self.base}/{len(self.tables)}"
        with short_batches(self.spark):
            df.write.parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def leave(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which the result still reads."""
        for df, path in self.tables:
            if not any(df is t for t in tables):
                remove(self.spark, path)

    def last(self, df: DataFrame) -> DataFrame:
        """Write the result and delete the intermediate tables."""
        path = f"{self.base}-result"
        with short_batches(self.spark):
            df.write.parquet(path)
        remove(self.spark, self.base)
        return self.spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later passes read what this one wrote, whatever executors are lost."""
    shared_dir(df.sparkSession)
    with short_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that no other column has, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def unlike(columns: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns whose names don't clash with those of results, whatever their case: results replace the others."""
    low = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in low]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
