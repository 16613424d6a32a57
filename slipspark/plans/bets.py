"""Queries over slips: extraction, classification, settlement, summaries, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.combos import k_subsets, number_mask
from slipspark.functions.lets import built_once
from slipspark.functions.text import non_blank, raw_lines
from slipspark.functions.tokens import bettor_name
from slipspark.operators import classify as cl
from slipspark.operators import extract as ex
from slipspark.operators import settle as st
from slipspark.operators import summary as sm
from slipspark.operators.report import reports
from slipspark.sources import fixtures as fx
from slipspark.sources.slips import to_long

AMOUNTS = {"amount", "bet_amount", "win_amount", "total_bet_amount", "total_win_amount", "stake"}
COUNTS = {"ord", "combo_count", "hit_count", "win_units", "slip_id"}


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Plain output types: bigint counts, double amounts, arrays as dotted text."""

    def plain(name: str) -> Column:
        if name in AMOUNTS:
            return F.col(name).cast("double")
        if name in COUNTS:
            return F.col(name).cast("bigint")
        if name == "numbers":
            return F.array_join("numbers", ".")
        if name == "number_set":
            return F.array_join(F.array_sort("numbers"), ".")
        return F.col(name)

    return rows.select(*[plain(name).alias(name) for name in columns])


def _extraction(text: Callable, extractor: Callable[..., Column], *columns: str):
    build = built_once(extractor)

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = ex.group_rows(fx.texts(spark, sf, text), build("text"))
        return shown(rows, "slip_id", "ord", "user_name", "amount", "bet_amount", *columns)

    return query


def _by_line(extractor: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    def of_text(text: Column) -> Column:
        each = lambda line, i: extractor(line, bettor_name(line, i))
        return F.flatten(F.transform(non_blank(raw_lines(text)), each))

    return of_text


def settled_groups(spark: SparkSession, sf: str, modes: tuple[str, ...] = tuple(dims.MODES)) -> DataFrame:
    """Every group of every slip, or of its texts of some modes, with the hits of its draw."""
    drawn = st.with_draw(fx.slips(spark, sf), st.draw_inputs(fx.draws(spark, sf)))
    long = to_long(drawn, ("slip_id", "draw_date", "special", "drawn", "drawn_zodiacs", "draw_zodiac"), modes)
    keys = ("slip_id", "mode", "draw_date", "special", "drawn", "drawn_zodiacs", "draw_zodiac")
    return st.settle_rows(ex.extract(long, keys))


def settled_slips(spark: SparkSession, sf: str) -> DataFrame:
    """Every slip with its group and winner arrays, still one row per slip."""
    drawn = st.with_draw(fx.slips(spark, sf), st.draw_inputs(fx.draws(spark, sf)))
    return sm.with_winners(ex.with_groups(drawn))


def bets_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = ex.extract(to_long(fx.slips(spark, sf)))
    return shown(rows, "slip_id", "mode", "ord", "family", "number_set", "amount", "bet_amount")


def group_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = ex.extract(to_long(fx.slips(spark, sf)))
    return rows.groupBy("mode", "family", "user_name").agg(
        F.count("*").alias("groups"), F.sum("bet_amount").cast("double").alias("stake")
    )


def settle_all(spark: SparkSession, sf: str) -> DataFrame:
    return shown(settled_groups(spark, sf), "slip_id", "mode", "ord", "hit_count", "win_units", "win_amount")


def _hits(kind: str):
    # The filter on the kind can't pass extraction by itself; that on the mode it implies is put before.
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = settled_groups(spark, sf, (ex.KIND_MODE[kind],)).filter((F.col("kind") == kind) & (F.col("hit_count") > 0))
        return shown(rows, "slip_id", "mode", "ord", "hit_count", "win_units")

    return query


def payout(spark: SparkSession, sf: str) -> DataFrame:
    rows = settled_groups(spark, sf)
    return rows.groupBy("draw_date", "kind").agg(
        F.count("*").alias("groups"),
        F.sum("win_units").alias("win_units"),
        F.sum("win_amount").cast("double").alias("win_amount"),
    ).withColumn("draw_date", F.col("draw_date").cast("string"))


def winners(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.winner_rows(settled_groups(spark, sf))
    return shown(rows, "slip_id", "mode", "ord", "user_name", "win_amount")


def hit_text(spark: SparkSession, sf: str) -> DataFrame:
    return shown(st.winner_rows(settled_groups(spark, sf)), "slip_id", "mode", "ord", "hit_content")


def drawn_set(spark: SparkSession, sf: str) -> DataFrame:
    inputs = st.draw_inputs(fx.draws(spark, sf))
    return inputs.select(
        F.col("draw_date").cast("string").alias("draw_date"),
        F.array_join("drawn", ".").alias("drawn"),
        number_mask(F.col("drawn")).alias("drawn_mask"),
    )


def drawn_zodiacs(spark: SparkSession, sf: str) -> DataFrame:
    inputs = st.draw_inputs(fx.draws(spark, sf))
    return inputs.select(
        F.col("draw_date").cast("string").alias("draw_date"),
        "draw_zodiac",
        F.array_join(F.array_sort("drawn_zodiacs"), "").alias("zodiacs"),
    )


SUMMARY = ("total_bet_amount", "total_win_amount", "entry_count", "group_count")


def summary_mode(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sm.mode_summaries(settled_slips(spark, sf)), "slip_id", "mode", *SUMMARY)


def summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sm.all_mode_summaries(settled_slips(spark, sf)), "slip_id", *SUMMARY, "winner_count")


def summary_draft(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sm.draft_summaries(fx.slips(spark, sf)), "slip_id", *SUMMARY)


def summary_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per draw and mode over all slips."""
    per_mode = sm.mode_summaries(settled_slips(spark, sf), ("slip_id", "draw_date"))
    totals = sm.roll_up(per_mode, ["draw_date", "mode"]).withColumn("draw_date", F.col("draw_date").cast("string"))
    return shown(totals, "draw_date", "mode", *SUMMARY, "winner_count", "slips")


def summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per draw and mode, per draw, and over everything."""
    per_mode = sm.mode_summaries(settled_slips(spark, sf), ("slip_id", "draw_date"))
    totals = sm.rolled_up(per_mode).withColumn("draw_date", F.col("draw_date").cast("string"))
    return shown(totals, "level", "draw_date", "mode", *SUMMARY, "winner_count", "slips")


def status_text(spark: SparkSession, sf: str) -> DataFrame:
    # One extraction of the slips gives both the modes' and the slips' totals.
    modes = [F.struct(F.lit("settled").alias("kind"), F.lit(m).alias("mode"), sm.totals(F.col(f"groups_{m}"), F.col(f"winners_{m}")).alias("t")) for m in dims.MODES]
    whole = F.struct(F.lit("whole").alias("kind"), F.lit("all").alias("mode"), sm.slip_totals().alias("t"))
    settled = settled_slips(spark, sf).select(F.explode(F.array(*modes, whole)).alias("s")).select("s.kind", "s.mode", "s.t.*")
    said = F.when(F.col("kind") == "whole", sm.status_text()).otherwise(sm.status_text(F.col("mode")))
    # A text of another mode parses to nothing, which shows the empty texts too.
    crossed = fx.slips(spark, sf).selectExpr(
        "slip_id", "lianma AS pingma", "pingma AS lianma", "'' AS fushi"
    )
    drafts = sm.mode_summaries(ex.with_groups(crossed), settled=False)
    rows = settled.unionByName(drafts.drop("slip_id").withColumn("kind", F.lit("crossed"))).select("kind", "mode", said.alias("status"))
    return rows.groupBy("kind", "mode", "status").agg(F.count("*").alias("slips"))


def report_text(spark: SparkSession, sf: str) -> DataFrame:
    return reports(settled_slips(spark, sf))


def classify_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cl.classify(fx.mixed_slips(spark, sf)).select("slip_id", *dims.MODES)


def classify_settle(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed texts classified, extracted, settled and summed up per draw."""
    wide = cl.classify(st.with_draw(fx.mixed_slips(spark, sf), st.draw_inputs(fx.draws(spark, sf))))
    per_mode = sm.mode_summaries(sm.with_winners(ex.with_groups(wide)), ("slip_id", "draw_date"))
    totals = sm.roll_up(per_mode, ["draw_date", "mode"]).withColumn("draw_date", F.col("draw_date").cast("string"))
    return shown(totals, "draw_date", "mode", *SUMMARY, "winner_count")


def append_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Two texts joined, and three image texts of which some are blank."""
    t = fx.SparkText
    rows = fx.keyed_orders(spark, sf).selectExpr(
        "k AS slip_id",
        f"CASE WHEN k % 3 = 0 THEN ' ' ELSE concat({fx.zodiac_text(t)}, {fx.NL}) END AS current",
        f"CASE WHEN c % 4 = 0 THEN NULL ELSE concat('  ', {fx.zodiac_pool_text(t)}) END AS addition",
    )
    images = F.array(F.col("current"), F.lit("　\n"), F.col("addition"), F.lit("0"))
    return rows.select(
        "slip_id",
        cl.join_texts(F.col("current"), F.col("addition")).alias("joined"),
        cl.join_all(images).alias("image_texts"),
    )


def combination_enum(spark: SparkSession, sf: str) -> DataFrame:
    """Every three of the four zodiacs of a pool, counted by where they stand."""
    groups = ex.group_rows(fx.texts(spark, sf, fx.zodiac_pool_text), _zodiac_pools("text"))
    combos = groups.select(F.explode(k_subsets(F.col("zodiacs"), 4, 3)).alias("combo"))
    return combos.groupBy(F.array_join("combo", "").alias("combo")).agg(F.count("*").alias("groups"))


_zodiac_pools = built_once(_by_line(ex.zodiac_pool_groups))


def recognition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per bucket and texts with any, over all classified texts."""
    wide = cl.classify(fx.mixed_slips(spark, sf))
    counts = F.array(
        *[F.struct(F.lit(mode).alias("mode"), cl.line_count(F.col(mode)).cast("bigint").alias("n")) for mode in dims.MODES]
    )
    rows = wide.select(F.explode(counts).alias("m")).select("m.*")
    return rows.groupBy("mode").agg(
        F.sum("n").alias("lines"), F.count_if(F.col("n") > 0).alias("texts"), F.max("n").alias("longest")
    )


QUERIES = {
    "bets_slash": _extraction(fx.slash_text, lambda text: ex.line_groups(text, ("slash",)), "numbers"),
    "bets_cn": _extraction(fx.cn_text, lambda text: ex.line_groups(text, ("cn",)), "numbers"),
    "bets_zodiac": _extraction(fx.zodiac_text, lambda text: ex.line_groups(text, ("zodiac",)), "label", "numbers"),
    "bets_pool_inline": _extraction(fx.inline_text, _by_line(ex.inline_pool_groups), "play", "combo_count", "numbers"),
    "bets_zodiac_pool": _extraction(fx.zodiac_pool_text, _by_line(ex.zodiac_pool_groups), "combo_count", "number_set"),
    "bets_slash_wrapped": _extraction(fx.slash_text, ex.wrapped_slash_groups, "numbers"),
    "bets_cn_wrapped": _extraction(fx.cn_text, ex.wrapped_chinese_groups, "numbers"),
    "bets_pool_block": _extraction(fx.block_text, ex.pool_block_groups, "play", "combo_count", "numbers"),
    "bets_listed": _extraction(fx.listed_text, ex.listed_groups, "play", "combo_count", "number_set"),
    "bets_all": bets_all,
    "group_names": group_names,
    "classify_lines": classify_lines,
    "classify_settle": classify_settle,
    "append_texts": append_texts,
    "combination_enum": combination_enum,
    "drawn_set": drawn_set,
    "drawn_zodiacs": drawn_zodiacs,
    "settle_all": settle_all,
    "hit_straight": _hits("straight"),
    "hit_pool": _hits("pool"),
    "hit_listed": _hits("listed"),
    "hit_zodiac": _hits("zodiac"),
    "payout": payout,
    "winners": winners,
    "hit_text": hit_text,
    "summary_mode": summary_mode,
    "summary_all": summary_all,
    "summary_draft": summary_draft,
    "summary_draw": summary_draw,
    "summary_rollup": summary_rollup,
    "status_text": status_text,
    "report_text": report_text,
    "recognition_counts": recognition_counts,
}
