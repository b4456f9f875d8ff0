"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.sources.folders import shared_dir
from keyloom.sources.keyspaces import spread

__all__ = ["SPACE_CLASS", "bucket_of", "cut", "drop", "numbered", "piled", "read_table", "returning", "scope", "shared_dir", "spread", "sweep", "words"]

#: The white space that parts words, as a character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Settings while a table is written. Whole texts are read a few at a time: by default a reader's batch has 4,096 rows, whatever their length.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.columnarReaderBatchSize": "256"}
GROUP_BYTES = 16 << 20  # of a written table's row groups, one of which each writing and each reading task holds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: ContextVar[list[str] | None] = ContextVar("tables made in the innermost scope", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``cut`` writes inside, for ``drop`` once nothing reads them."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    Rows come back from storage that outlives every executor, compressed and by column. The shuffle files
    that led to them go as soon as they are written. What tasks hold of the texts that they read and write does
    not grow with the table: batches of a few rows, and row groups of bounded size.
    """
    return piled(df.sparkSession, [df])


def piled(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame:
    """``cut`` of several frames of one schema, one after the other, into one table."""
    path, schema = f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}", None
    before = {name: spark.conf.get(name) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        for df in frames:
            df.write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(path)
            schema = df.schema
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, paths: Sequence[str]) -> int:
    """Delete tables that ``cut`` has written; results read from them must be stored first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = [hadoop.Path(p) for p in paths]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in found)


def sweep(spark: SparkSession) -> int:
    """``drop`` all tables that ``cut`` has written for this application."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}-*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return drop(spark, [status.getPath().toString() for status in system.globStatus(pattern)])


def numbered(rows: DataFrame, keys: Sequence[str], to: str) -> DataFrame:
    """``rows`` with ``to``, counting from 0 within each group of ``keys`` (nulls are equal); no group is counted by one task.

    Which of a group's rows gets which number depends on how they are dealt to tasks, so use it to count
    alike rows only. The rows are written first, so that numbers hold however often they are read.
    """
    held = cut(rows.withColumn("__number_salt", F.spark_partition_id()))
    sums = held.groupBy(*keys, "__number_salt").agg(F.count("*").alias("__number_n"))
    before = F.sum("__number_n").over(W.partitionBy(*keys).orderBy("__number_salt")) - F.col("__number_n")
    base = sums.select(*[F.col(k).alias(f"__number_k{i}") for i, k in enumerate(keys)], F.col("__number_salt").alias("__number_s"), before.alias("__number_before"))
    nth = held.withColumn("__number_nth", F.row_number().over(W.partitionBy(*keys, "__number_salt").orderBy(F.lit(0))) - 1)
    same = F.col("__number_salt") == F.col("__number_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__number_k{i}"))
    return nth.join(base, same).select(*rows.columns, (F.col("__number_nth") + F.col("__number_before")).cast("long").alias(to))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
        trim(0)


def returning(work: Callable[[Iterator], Iterator], batches: Iterator) -> Iterator:
    """What ``work`` makes of a task's ``batches``; free memory goes back to the system before and after.

    Spark keeps Python workers for later tasks, and their allocators keep what earlier tasks needed, so
    that an executor's workers would hold the most that any stage has taken.
    """
    _give_back()
    try:
        yield from work(batches)
    finally:
        _give_back()


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
