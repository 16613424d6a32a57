"""Mixed texts to per-mode texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.lets import built_once, empty, let
from slipspark.functions.text import JS_WS, js_trim, nullif_blank
from slipspark.functions.tokens import numbers_in, play_of, trailing_amount
from slipspark.operators.extract import inline_pool_groups, zodiac_pool_groups

ROUTED = "array<struct<bucket:string,line:string>>"
_Z = f"[{dims.ZODIAC_ORDER}]"


def tidy_lines(text: Column) -> Column:
    """Lines with separators unified and whitespace removed, blank ones dropped."""
    lines = F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.regexp_replace(F.translate(line, "|。．，,", "/...."), f"[{JS_WS}]+", ""),
    )
    return F.filter(lines, lambda line: line != "")


def _facts(line: Column) -> Column:
    """What a line is by itself; the fold adds what came before it."""
    first = F.struct(
        play_of(line).alias("play"),
        F.size(numbers_in(line)).alias("count"),
        line.contains("/").alias("slash"),
        (line.contains("复式") | line.contains("复试")).alias("pooled"),
    )

    def with_first(x: Column) -> Column:
        priced = (x.play != "") & (trailing_amount(line) > 0)
        unpriced_play = x.play == dims.UNPRICED_PLAY
        inline = (x.play != "") & ~unpriced_play & x.slash & (F.size(inline_pool_groups(line, F.lit(""))) > 0)
        zodiac_pool = (x.play == dims.ZODIAC_POOL_PLAY) & (F.size(zodiac_pool_groups(line, F.lit(""))) > 0)
        straight = x.slash | line.rlike(rf"号|各[下押买]|{_Z}\d")
        return F.struct(
            line.alias("line"),
            (inline | zodiac_pool | (unpriced_play & priced)).alias("complete_pool"),
            (x.pooled & priced).alias("pool_header"),
            (~x.pooled & priced & (x["count"] >= 2)).alias("listed_close"),
            straight.alias("straight"),
            ((x["count"] >= 2) & ~straight).alias("numbers_only"),
            ((x.play == "") & (x["count"] >= 2)).alias("may_continue"),
            line.rlike(r"/\d*\z|\.\d\z").alias("open_end"),
        )

    return let(first, with_first)


def route_lines(text: Column) -> Column:
    """Array of (bucket, line) in output order; lines that say nothing about a bet are gone.

    One fold per text: numbers after a pool header belong to it, numbers before a priced line are listed combinations,
    and numbers after an unfinished slash line continue it.
    """

    def routed(bucket: str, line: Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), line.alias("line"))

    def state(out, header, listed, mode, open_end) -> Column:
        return F.struct(
            out.alias("out"),
            header.alias("header"),
            listed.alias("listed"),
            mode.alias("mode"),
            open_end.alias("open_end"),
        )

    none = empty(ROUTED)

    def step(acc: Column, x: Column) -> Column:
        flushed = F.concat(acc.out, acc.listed, acc.header)
        to = lambda bucket: routed(bucket, x.line)
        mode = lambda name: F.lit(name)
        continues = (acc.mode == "pingma") & x.may_continue & acc.open_end
        return (
            F.when(x.complete_pool, state(F.array_append(flushed, to("fushi")), none, none, mode("fushi"), acc.open_end))
            .when(x.pool_header, state(flushed, F.array(to("fushi")), none, mode("fushi"), acc.open_end))
            .when(
                (F.size(acc.header) > 0) & x.numbers_only,
                state(acc.out, F.array_append(acc.header, to("fushi")), acc.listed, mode("fushi"), acc.open_end),
            )
            .when(
                x.listed_close,
                state(
                    F.array_append(F.concat(acc.out, acc.header, acc.listed), to("lianma")),
                    none,
                    none,
                    mode("lianma"),
                    acc.open_end,
                ),
            )
            .when(
                x.straight | continues,
                state(F.array_append(flushed, to("pingma")), none, none, mode("pingma"), x.open_end),
            )
            .when(
                x.numbers_only & (acc.mode == "fushi"),
                state(F.array_append(acc.out, to("fushi")), acc.header, acc.listed, acc.mode, acc.open_end),
            )
            .when(
                x.numbers_only,
                state(acc.out, acc.header, F.array_append(acc.listed, to("lianma")), mode("lianma"), acc.open_end),
            )
            .otherwise(acc)
        )

    zero = state(none, none, none, F.lit("pingma"), F.lit(False))
    return F.aggregate(
        F.transform(tidy_lines(text), _facts),
        zero,
        step,
        lambda acc: F.concat(acc.out, acc.listed, acc.header),
    )


_routes = built_once(route_lines)


def bucket_text(routes: Column, bucket: str) -> Column:
    lines = F.filter(routes, lambda r: r.bucket == bucket)
    return F.array_join(F.transform(lines, lambda r: r.line), "\n")


def classify(texts: DataFrame, text: str = "raw_text") -> DataFrame:
    """Mixed texts plus one text column per mode: wide slips. Map-only."""
    routed = texts.withColumn("routes", _routes(text))
    return routed.withColumns({mode: bucket_text(F.col("routes"), mode) for mode in dims.MODES}).drop("routes")


def join_texts(current: Column, addition: Column) -> Column:
    """Append a text to another on a new line; blanks add nothing."""
    tidy = lambda text: nullif_blank(js_trim(F.coalesce(text, F.lit(""))))
    return F.concat_ws("\n", tidy(current), tidy(addition))


def join_all(texts: Column) -> Column:
    """Join an array of texts, say of several images, in array order."""
    tidy = F.transform(texts, lambda text: js_trim(F.coalesce(text, F.lit(""))))
    return F.array_join(F.filter(tidy, lambda text: text != ""), "\n")


def line_count(text: Column) -> Column:
    """Lines of a bucket text that are not empty."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda line: line != ""))
