"""Combination counts and k-subsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combination_count(total: Column, pick: Column) -> Column:
    """C(total, pick); 0 when pick is not positive or exceeds total. Picks 2 and 3 need no loop."""
    n = total.cast("bigint")
    k = pick.cast("bigint")
    # Each prefix product over j factors is divisible by j!, so exact integer division is safe.
    general = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))),
        F.lit(1).cast("bigint"),
        lambda acc, i: F.call_function("div", acc * (n - i + 1), i),
    )
    return (
        F.when((k <= 0) | (n < k), F.lit(0).cast("bigint"))
        .when(k == 2, F.call_function("div", n * (n - 1), F.lit(2)))
        .when(k == 3, F.call_function("div", n * (n - 1) * (n - 2), F.lit(6)))
        .otherwise(general)
    )


def k_subsets(items: Column, size: int, pick: int) -> Column:
    """All subsets of ``pick`` members of an array of known ``size``, in input order."""

    def positions(start: int, left: int) -> list[tuple[int, ...]]:
        if left == 0:
            return [()]
        return [(i, *rest) for i in range(start, size - left + 1) for rest in positions(i + 1, left - 1)]

    return F.array(*[F.array(*[F.get(items, F.lit(i)) for i in chosen]) for chosen in positions(0, pick)])


def number_mask(numbers: Column) -> Column:
    """Set of numbers as a 64-bit mask; 49 members fit."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        numbers, F.lit(0).cast("bigint"), lambda acc, n: acc.bitwiseOR(F.call_function("shiftleft", one, n))
    )
