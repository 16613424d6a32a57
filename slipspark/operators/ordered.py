"""Previous-row logic that splits a hot key over time buckets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str = "previous"
) -> DataFrame:
    """``value`` of the row before, per key in order; NULL on a key's first row.

    A window over the key alone would put all rows of a hot key in one task. Here the window runs per key and bucket,
    and the last value of each bucket is handed to the next one through a table with one row per bucket. ``value`` must
    be a struct, so that a NULL field differs from a missing row, and ``bucket`` must not decrease along the order.
    """
    split = rows.withColumn("_bucket", bucket)
    inside = F.lag(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ends = split.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket"))
    handed = ends.withColumn("_carry", carried).drop("_end")
    # null-safe: rows without a key or a time are a key and a bucket of their own
    named = handed.select(*(F.col(c).alias(f"_key_{c}") for c in (*keys, "_bucket")), "_carry")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in (*keys, "_bucket")))
    return (
        split.withColumn("_inside", inside)
        .join(named, same)
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_bucket", "_inside", "_carry", *(f"_key_{c}" for c in (*keys, "_bucket")))
    )
