"""Slip tables: one row per slip with a text per mode, or one row per slip and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark import dims

WIDE_DDL = "slip_id bigint, pingma string, lianma string, fushi string"
LONG_DDL = "slip_id bigint, mode string, raw_text string"


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """A folder of text files, one slip each, all of one mode; the file path names the slip.

    File sources leave out files of zero bytes, so a slip without any text must come as a table row.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("slip_id"),
        F.input_file_name().alias("path"),
        F.lit(mode).alias("mode"),
        F.col("value").alias("raw_text"),
    )


def to_long(slips: DataFrame, keys: tuple[str, ...] = ("slip_id",), modes: tuple[str, ...] = tuple(dims.MODES)) -> DataFrame:
    """Wide slips to (keys, mode, raw_text)."""
    return slips.select(*keys, *modes).unpivot(list(keys), list(modes), "mode", "raw_text")
