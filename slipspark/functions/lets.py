"""Small helpers for row-local expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A fold over nothing hands its start to its finish as it is; a transform would copy what the body returns, nested rows and all.
    """
    return F.aggregate(empty("array<int>"), value, lambda bound, _: bound, body)


def empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def exploded(rows: DataFrame, keys: tuple[str, ...], items: str, item: str, position: str | None = None) -> DataFrame:
    """One row per array member, with its position if named.

    An inner explode of a column lets the optimizer add a filter on the array's size and push it, with the whole
    expression behind the column, down to the scan, where everything is computed a second time. The outer form does not.
    """
    if position is None:
        return rows.select(*keys, F.explode_outer(items).alias(item)).filter(F.col(item).isNotNull())
    return rows.select(*keys, F.posexplode_outer(items).alias(position, item)).filter(F.col(position).isNotNull())


def built_once(builder: Callable[..., Column]) -> Callable[..., Column]:
    """Reuse a large expression over named columns.

    Building one takes thousands of driver-side calls; the finished tree is unresolved, so it fits any DataFrame that
    has the columns. Arguments are column names.
    """

    @lru_cache(maxsize=64)
    def build(_gateway: int, *names: str) -> Column:
        return builder(*[F.col(name) for name in names])

    @wraps(builder)
    def call(*names: str) -> Column:
        return build(id(SparkContext._gateway), *names)

    return call
