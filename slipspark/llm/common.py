"""Helpers that the operators share: written tables, row identity, word bytes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.session import shared_dir

#: Bytes that end a word where words are runs of anything but ASCII white space.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, readable from every executor."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: str | Column) -> Column:
    """The text as bytes; null is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


#: Texts in a batch between Spark and Python: long ones come too, and a task holds a batch on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Called before texts go to Python. A session that has chosen fewer rows keeps its choice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


_MEMORY: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None]) -> None:
    """Called where a task of ``owner`` begins. Spark hands its Python workers from one operator to the next; what the one
    before remembered is dropped, so a worker never holds the memories of two."""
    for other in [o for o in _MEMORY if o != owner]:
        _MEMORY.pop(other)()
    _MEMORY[owner] = forget
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
