"""Chat images: recognised boxes to lines in reading order, and lines to bet text.

An image is one row and its boxes an array in it, so both steps are folds inside the row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.lets import built_once, empty
from slipspark.functions.text import PY_LINE_BREAK, PY_WS
from slipspark.sources.ocr import with_items

# Fixed patterns; digits are Unicode digits here.
_D = r"\p{Nd}"
CONTENT = (
    rf"{_D}[./]{_D}|{_D}号|各下|各押|各买|一个号|每号|平码|平马|连码|复试|复式|二中二|二中三|三中三|[{dims.ZODIAC_ORDER}]"
)
BARE_AMOUNT = rf"^{_D}{{1,4}}元?\z"
WAITS_AMOUNT = rf"(?:各下|各押|各买|下|押|买)\P{{Nd}}*\z"
TWO_DIGITS = rf"^{_D}{{1,2}}\z"
CUT_AMOUNT = rf"/{_D}{{1,2}}\z"
# Two or more chunks of one or two digits, each with at most one separator before it. As one pattern this splits a digit
# run in countless ways; as three plain tests it is linear: only digits and separators, no separator doubled or last,
# and two digits or more.
CHUNK_CHARS = rf"^[./{_D}]+\z"
CHUNK_FAULT = r"[./][./]|[./]\z"
CHUNK_PAIR = rf"{_D}[./]?{_D}"
CUT_NUMBER = rf"(?:\.{_D}|/{_D}*)\z"


def merged_lines(items: Column) -> Column:
    """Texts in reading order: banded by height, then left to right; near heights share a line."""
    ordered = F.array_sort(
        F.transform(
            items,
            lambda i: F.struct(
                F.rint(F.coalesce(i["y"], F.lit(0.0)) / dims.LINE_BAND).alias("band"),
                F.coalesce(i["x"], F.lit(0.0)).alias("x"),
                i["seq"].alias("seq"),
                F.coalesce(i["y"], F.lit(0.0)).alias("y"),
                i["text"].alias("text"),
            ),
        )
    )

    def state(height, line, lines) -> Column:
        return F.struct(height.alias("height"), line.alias("line"), lines.alias("lines"))

    def step(acc: Column, i: Column) -> Column:
        same_line = acc.height.isNull() | (F.abs(i["y"] - acc.height) <= dims.LINE_GAP)
        middle = F.coalesce((acc.height + i["y"]) / 2, i["y"])
        return F.when(same_line, state(middle, F.concat(acc.line, i["text"]), acc.lines)).otherwise(
            state(i["y"], i["text"], F.array_append(acc.lines, acc.line))
        )

    zero = state(F.lit(None).cast("double"), F.lit(""), empty("array<string>"))
    finish = lambda acc: F.when(acc.height.isNull(), acc.lines).otherwise(F.array_append(acc.lines, acc.line))
    return F.aggregate(ordered, zero, step, finish)


def normalized_lines(text: Column) -> Column:
    """Lines of a raw text with separators unified and whitespace removed, blank ones dropped."""
    lines = F.transform(
        F.split(text, PY_LINE_BREAK),
        lambda line: F.regexp_replace(F.translate(line, "|：。，", "/:.,"), f"[{PY_WS}]+", ""),
    )
    return F.filter(lines, lambda line: line != "")


def content_lines(text: Column) -> Column:
    """Lines that say something about a bet by themselves."""
    return F.filter(normalized_lines(text), lambda line: line.rlike(CONTENT))


def kept_lines(text: Column) -> Column:
    """Content lines, and the lines that continue the last kept one."""
    facts = F.transform(
        normalized_lines(text),
        lambda line: F.struct(
            line.alias("line"),
            line.rlike(CONTENT).alias("content"),
            line.rlike(BARE_AMOUNT).alias("bare_amount"),
            line.rlike(TWO_DIGITS).alias("two_digits"),
            (line.rlike(CHUNK_CHARS) & ~line.rlike(CHUNK_FAULT) & line.rlike(CHUNK_PAIR)).alias("chunks"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        continues = (F.size(acc) > 0) & (
            (x.bare_amount & last.rlike(WAITS_AMOUNT))
            | (x.two_digits & last.rlike(CUT_AMOUNT))
            | (x.chunks & last.rlike(CUT_NUMBER))
        )
        return F.when(x.content | continues, F.array_append(acc, x.line)).otherwise(acc)

    return F.aggregate(facts, empty("array<string>"), step)


def clean_text(text: Column) -> Column:
    return F.array_join(kept_lines(text), "\n")


_clean = built_once(clean_text)
_merged = built_once(merged_lines)


def chat_texts(images: DataFrame) -> DataFrame:
    """Chat images plus ``raw_text`` as recognised and ``text`` with bet lines only. Map-only."""
    read = with_items(images).withColumn("raw_text", F.array_join(_merged("items"), "\n"))
    return read.withColumn("text", _clean("raw_text"))


def clean_chats(texts: DataFrame, text: str = "text") -> DataFrame:
    """Raw texts plus ``cleaned``."""
    return texts.withColumn("cleaned", _clean(text))
