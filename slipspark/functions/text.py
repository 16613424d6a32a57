"""Whitespace, line and number-format rules shared by all jobs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.functions.lets import let

# Code points of whitespace as browsers define it, as Unicode str regexes define it, and of line breaks
# as Python's splitlines knows them. (Plain \s in Java is ASCII only.)
_JS_SPACE = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_PY_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PY_BREAK = [*range(0x0A, 0x0E), *range(0x1C, 0x1F), 0x85, 0x2028, 0x2029]


def _class_body(points: list[int]) -> str:
    """Body of a character class; runs become ranges, which match much faster than single members."""
    runs: list[list[int]] = []
    for point in points:
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    name = lambda point: f"\\x{{{point:X}}}"
    return "".join(name(low) if low == high else f"{name(low)}-{name(high)}" for low, high in runs)


JS_SPACE_CHARS = "".join(map(chr, _JS_SPACE))
# Java's own classes for horizontal and vertical space cover the browser's but for three members; they match faster than
# a list, and stand last in a class because of the intersection.
JS_WS = r"\h\v\x{FEFF}&&[^\x85\x{180E}]"
# A text is searched for this one, so what most characters are is ruled out by a byte or a range first.
_INNER_WS = r"(?:[\t\x0B-\r \xA0]|[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]|\x{FEFF})"
_EDGE_WS = rf"{_INNER_WS}(?:\n|\z)|(?:^|\n){_INNER_WS}"
PY_WS = _class_body(_PY_SPACE)
PY_LINE_BREAK = f"[{_class_body(_PY_BREAK)}]"

# 24 whole digits and 4 decimals hold any amount met in practice; products and sums get the full width.
AMOUNT = T.DecimalType(28, 4)
MONEY = T.DecimalType(38, 4)


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_SPACE_CHARS))


def raw_lines(text: Column) -> Column:
    """Trimmed lines, blank ones kept, so array positions are raw line indexes.

    Trimming takes the carriage return that may stand before a line feed. A text without other whitespace at the edge of a
    line has nothing to trim; one look at the text is cheaper than one at both ends of each line.
    """
    lines = F.split(text, "\n")
    return F.when(text.rlike(_INNER_WS) & text.rlike(_EDGE_WS), F.transform(lines, js_trim)).otherwise(lines)


def non_blank(lines: Column) -> Column:
    return F.filter(lines, lambda l: l != "")


def amount_of(digits: Column) -> Column:
    return digits.try_cast(AMOUNT)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Byte search for any of the words; cheaper than a pattern where only presence matters."""
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def plain_number(value: Column) -> Column:
    """Decimal as 940 or 2.5: no trailing zeros, no exponent."""
    return F.regexp_replace(value.cast(MONEY).cast("string"), r"\.?0+\z", "")


def nullif_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def round_binary(value: Column, places: int) -> Column:
    """A double from 0 on, rounded half to even by its exact binary value, as Python's ``round`` does.

    ``bround`` looks at the shortest decimal print. That differs only where the print ends in a 5 just behind the last
    place; there the sign of the double's distance to that decimal decides, which a product in two exact halves gives.
    """
    scale = float(10 ** (places + 1))

    def decided(x: Column) -> Column:
        n = F.round(x * scale)
        high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the bits
        off = (high * scale - n) + (x - high) * scale
        up = F.when(off == 0, (n - 5) / 10 % 2 != 0).otherwise(off > 0)
        tie = (n % 10 == 5) & (F.abs(x * scale - n) < 1e-3)
        return F.when(tie, ((n - 5) / 10 + up.cast("int")) / (scale / 10)).otherwise(F.bround(x, places))

    return let(value, decided)
