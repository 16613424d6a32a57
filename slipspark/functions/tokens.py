"""Tokens of the bet language: numbers, zodiacs, names, plays, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.lets import let
from slipspark.functions.text import AMOUNT, JS_WS, amount_of, js_trim

# A whole digit run whose value is 1..49, leading zeros allowed.
_NUMBER_RUN = r"(?<!\d)0*([1-9]|[1-4]\d)(?!\d)"
_TRAILING_AMOUNT = rf"(?<!\d)(\d++(?:\.\d++)?)[{JS_WS}]*+元?[{JS_WS}]*+\z"
_NAME = rf"^[{JS_WS}]*([^0-9/：:，,.{JS_WS}]{{1,16}})[{JS_WS}]*[：:，,{JS_WS}]"


def normalize_number(text: Column) -> Column:
    """1..49, or NULL."""
    value = F.regexp_extract(js_trim(text), r"^\+?(\d+)(?:\.0*)?\z", 1).try_cast("int")
    return F.when(value.between(1, dims.MAX_NUMBER), value)


def numbers_in(text: Column) -> Column:
    """Numbers of a text as an ordered bag."""
    return F.regexp_extract_all(text, F.lit(_NUMBER_RUN), F.lit(1)).cast("array<int>")


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def number_zodiac(number: Column, order: str = dims.ZODIAC_ORDER) -> Column:
    """Zodiac of a number; NULL outside 1..49."""
    zodiac = F.substring(F.lit(order), F.pmod(number - 1, F.lit(12)) + 1, F.lit(1))
    return F.when(number.between(1, dims.MAX_NUMBER), zodiac)


def zodiac_numbers(zodiac: Column, order: str = dims.ZODIAC_ORDER) -> Column:
    """Numbers of a zodiac: every twelfth one from its place in the sequence."""
    return F.sequence(F.instr(F.lit(order), zodiac), F.lit(dims.MAX_NUMBER), F.lit(12))


def bettor_name(line: Column, index: Column) -> Column:
    numbered = F.concat(F.lit("第"), (index + 1).cast("string"), F.lit("行"))
    return let(F.regexp_extract(line, _NAME, 1), lambda found: F.when(found == "", numbered).otherwise(found))


def play_of(line: Column) -> Column:
    """Play named on a line, or ''."""
    two, three = line.contains("二中二"), line.contains("二中三")
    return (
        F.when(~line.contains("中") & ~line.contains("复四三"), F.lit(""))
        .when(line.contains("复四三"), F.lit("复四三"))
        .when(two & three, F.regexp_extract(line, "二中[二三]", 0))
        .when(two, F.lit("二中二"))
        .when(three, F.lit("二中三"))
        .when(line.contains("三中三"), F.lit("三中三"))
        .otherwise(F.lit(""))
    )


def play_pick(play: Column) -> Column:
    return _by_play(play, 0)


def play_odds(play: Column) -> Column:
    return _by_play(play, 1)


def _by_play(play: Column, field: int) -> Column:
    chain = F.lit(None).cast("int")
    for name, values in dims.PLAYS.items():
        chain = F.when(play == name, F.lit(values[field])).otherwise(chain)
    return chain


def trailing_amount(line: Column) -> Column:
    """Amount that ends the line, 0 when there is none.

    The words before the amount (每组, 各, 出 ...) hold no digits, so they never move its start.
    """
    zero = F.lit(0).cast(AMOUNT)
    # A failed cast throws inside, which costs more than all the rest of a line: nothing found isn't cast.
    amount = lambda digits: F.when(digits == "", zero).otherwise(F.coalesce(amount_of(digits), zero))
    return let(F.regexp_extract(line, _TRAILING_AMOUNT, 1), amount)


def numbers_before_play(line: Column, play: Column) -> Column:
    """Distinct numbers left of the play word, or of the whole line when no play is named."""
    head = F.when(play == "", line).otherwise(F.call_function("substring_index", line, play, F.lit(1)))
    return F.array_distinct(numbers_in(head))


def cn_integer(text: Column) -> Column:
    """Arabic or Chinese integer up to 99; 0 when it is neither."""
    ten = F.instr(text, "十")
    left = F.substring(text, F.lit(1), ten - 1)
    right = F.substring(text, ten + 1, F.length(text))
    zero = F.lit(0).cast(AMOUNT)
    spelled = (
        F.when(ten == 0, _cn_digit(text))
        .when(left == "", 10 + _cn_digit(right))
        .otherwise(_cn_digit(left) * 10 + _cn_digit(right))
    )
    return F.when(text.rlike(r"^\d+\z"), F.coalesce(amount_of(text), zero)).otherwise(spelled.cast(AMOUNT))


def _cn_digit(text: Column) -> Column:
    place = F.instr(F.lit(dims.CN_DIGITS), F.translate(text, "两", "二"))
    return F.when((F.length(text) == 1) & (place > 0), place - 1).otherwise(F.lit(0))


def clean_amount_web(text: Column) -> Column:
    """Cell amount as the web form reads it: ASCII digits, capital S only; '' when rejected."""
    digits = F.regexp_replace(F.translate(text, "OoIl|S", "001115"), r"\D+", "")
    return _cell_amount(digits)


def clean_amount_service(text: Column) -> Column:
    """Cell amount as the recognition service reads it: any Unicode digits, s like S; '' when rejected."""
    digits = F.regexp_replace(F.translate(text, "OoIl|Ss", "0011155"), r"\P{Nd}+", "")
    # The full-width digits, which OCR emits; other scripts keep their rejection below.
    return _cell_amount(F.translate(digits, "０１２３４５６７８９", "0123456789"))


def _cell_amount(digits: Column) -> Column:
    value = digits.try_cast("decimal(38,0)")
    accepted = value.between(1, dims.MAX_CELL_AMOUNT)
    return F.when(accepted, value.cast("int").cast("string")).otherwise(F.lit(""))
