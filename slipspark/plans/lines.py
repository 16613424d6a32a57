"""Queries over line tables: each token rule applied to every line item, summed up per value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.functions import tokens
from slipspark.functions.combos import combination_count
from slipspark.functions.lets import exploded
from slipspark.functions.text import non_blank, raw_lines
from slipspark.sources import fixtures as fx
from slipspark.sources.slips import to_long

PLAYS_SEEN = ["二中二", "二中三", "三中三", "复四三", "复四三二中二", ""]
PLAY_WORDS = ["各", "每组", "出", "", "一组 "]

TOKEN_LINE = (
    "CASE ln % 4 WHEN 0 THEN cast(p % 60 as string) WHEN 1 THEN lpad(cast(s % 60 as string), 3, '0') "
    "WHEN 2 THEN concat(' ', cast(q as string), ' ') ELSE concat('x', cast(q as string)) END"
)
NUMBER_LINE = (
    "concat(cast(p % 60 as string), '.', lpad(cast(s % 60 as string), 3, '0'), '..', cast(ln as string), '/', cast(q as string))"
)
NAME_LINE = (
    "CASE ln % 5 WHEN 0 THEN concat(' ', translate(cast(s as string), '0123456789', 'abcdefghij'), '：', cast(q as string)) "
    "WHEN 1 THEN concat('张三, ', cast(q as string), '/5') WHEN 2 THEN concat(cast(q as string), '.', cast(s as string), '/5') "
    "WHEN 3 THEN concat('abcdefghijklmnopq：', cast(q as string)) ELSE concat('狗 ', cast(q as string)) END"
)


def play_line(t) -> str:
    return (
        f"concat(cast(p % 60 as string), '.', cast(s % 60 as string), '.', cast(p % 60 as string), {t.pick(PLAYS_SEEN, 'p % 6')}, "
        f"{t.pick(PLAY_WORDS, 's % 5')}, cast(q as string), CASE WHEN o % 2 = 0 THEN '.5' ELSE '' END, "
        "CASE WHEN o % 3 = 0 THEN '元 ' ELSE '' END)"
    )


def cn_line(t) -> str:
    digits = ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
    ones = t.pick(digits, "q % 10")
    tens = t.pick(["", ""] + digits[2:], "(q - q % 10) / 10")
    spelled = f"concat({tens}, CASE WHEN q >= 10 THEN '十' ELSE '' END, {ones})"
    return (
        f"CASE ln % 5 WHEN 0 THEN cast(q as string) WHEN 1 THEN {spelled} WHEN 2 THEN concat('两十', {ones}) "
        f"WHEN 3 THEN concat('一百', {ones}) ELSE '' END"
    )


AMOUNT_LINE = (
    "CASE ln % 4 WHEN 0 THEN translate(cast(p as string), '015', 'OlS') WHEN 1 THEN concat(cast(q as string), '元s') "
    "WHEN 2 THEN concat('0', cast(p * 10 as string), '|') ELSE translate(cast(q as string), '0123456789', '０１２３４５６７８９') END"
)


def slip_source(spark: SparkSession, sf: str) -> DataFrame:
    long = to_long(fx.slips(spark, sf))
    return long.groupBy("mode").agg(
        F.count("*").alias("slips"),
        F.sum(F.length("raw_text")).alias("chars"),
        F.sum(F.size(F.split("raw_text", "\n")).cast("bigint")).alias("lines"),
    )


def slip_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw index, index among non-blank lines, and how many lines and characters stand there."""
    lines = to_long(fx.slips(spark, sf)).select("mode", raw_lines(F.col("raw_text")).alias("lines"))
    rows = exploded(lines, ("mode", "lines"), "lines", "line", "raw_idx").filter("line <> ''")
    before = F.slice("lines", F.lit(1), F.col("raw_idx"))
    return (
        rows.withColumn("nb_idx", F.size(non_blank(before)))
        .groupBy("mode", F.col("raw_idx").cast("bigint").alias("raw_idx"), F.col("nb_idx").cast("bigint").alias("nb_idx"))
        .agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))
    )


def normalize_number(spark: SparkSession, sf: str) -> DataFrame:
    number = tokens.normalize_number(F.col("line")).cast("bigint")
    return fx.lines(spark, sf, TOKEN_LINE).groupBy(number.alias("number")).agg(F.count("*").alias("tokens"))


def extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    found = fx.lines(spark, sf, NUMBER_LINE).select(F.explode(tokens.numbers_in(F.col("line"))).alias("n"))
    return found.groupBy(F.col("n").cast("bigint").alias("number")).agg(F.count("*").alias("entries"))


def number_zodiac(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("p") % 60).cast("int")
    zodiac = F.coalesce(tokens.number_zodiac(number), F.lit(""))
    return fx.keyed_lines(spark, sf).groupBy(zodiac.alias("zodiac")).agg(F.count("*").alias("entries"))


def zodiac_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.lines(spark, sf, fx.SparkText.pick(fx.ZODIACS, "p % 12"))
    return (
        rows.select("line", F.explode(tokens.zodiac_numbers(F.col("line"))).alias("n"))
        .groupBy(F.col("line").alias("zodiac"), F.col("n").cast("bigint").alias("number"))
        .agg(F.count("*").alias("entries"))
    )


def bettor_name(spark: SparkSession, sf: str) -> DataFrame:
    name = tokens.bettor_name(F.col("line"), F.col("ln"))
    return fx.lines(spark, sf, NAME_LINE).groupBy(name.alias("user_name")).agg(F.count("*").alias("lines"))


def _play_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.lines(spark, sf, play_line(fx.SparkText))
    return rows.withColumn("play", tokens.play_of(F.col("line")))


def play_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _play_rows(spark, sf).groupBy("play").agg(F.count("*").alias("lines"))


def trailing_amount(spark: SparkSession, sf: str) -> DataFrame:
    rows = _play_rows(spark, sf).withColumn("amount", tokens.trailing_amount(F.col("line")))
    return rows.groupBy("play").agg(
        F.count("*").alias("lines"),
        F.sum("amount").cast("double").alias("stake"),
        F.max("amount").cast("double").alias("highest"),
    )


def numbers_before_play(spark: SparkSession, sf: str) -> DataFrame:
    rows = _play_rows(spark, sf)
    found = tokens.numbers_before_play(F.col("line"), F.col("play"))
    return (
        rows.filter("play <> ''")
        .select("play", F.explode(found).alias("n"))
        .groupBy("play")
        .agg(F.count("*").alias("numbers"), F.sum("n").alias("number_sum"))
    )


def cn_integer(spark: SparkSession, sf: str) -> DataFrame:
    value = tokens.cn_integer(F.col("line")).cast("bigint")
    return fx.lines(spark, sf, cn_line(fx.SparkText)).groupBy(value.alias("value")).agg(F.count("*").alias("lines"))


def _amounts(spark: SparkSession, sf: str, clean) -> DataFrame:
    rows = fx.lines(spark, sf, AMOUNT_LINE).withColumn("amount", clean(F.col("line")))
    return rows.groupBy("amount").agg(F.count("*").alias("readings"))


def amount_clean_web(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf, tokens.clean_amount_web)


def amount_clean_svc(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf, tokens.clean_amount_service)


def combination_count_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.keyed_lines(spark, sf).select((F.col("q") % 20).alias("n"), (F.col("ln") % 6).alias("pick"))
    return rows.groupBy(
        F.col("n").cast("bigint").alias("n"),
        F.col("pick").cast("bigint").alias("pick"),
        combination_count(F.col("n"), F.col("pick")).alias("combos"),
    ).agg(F.count("*").alias("lines"))


QUERIES = {
    "slip_source": slip_source,
    "slip_lines": slip_lines,
    "normalize_number": normalize_number,
    "extract_numbers": extract_numbers,
    "number_zodiac": number_zodiac,
    "zodiac_numbers": zodiac_numbers,
    "bettor_name": bettor_name,
    "play_detect": play_detect,
    "trailing_amount": trailing_amount,
    "numbers_before_play": numbers_before_play,
    "cn_integer": cn_integer,
    "amount_clean_web": amount_clean_web,
    "amount_clean_svc": amount_clean_svc,
    "combination_count": combination_count_query,
}
