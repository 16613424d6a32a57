"""Report text of a settled slip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.functions.text import plain_number
from slipspark.functions.tokens import two_digits
from slipspark.operators.summary import slip_totals


def report_text(total: Column, winners: Column, special: Column, draw_zodiac: Column) -> Column:
    """Seven header lines, then one line per winner or a line saying there is none."""
    line = lambda label, value: F.concat(F.lit(label), value)
    winner_lines = F.transform(
        winners,
        lambda w: F.concat(w.user_name, F.lit("："), w.hit_content, F.lit("，中 "), plain_number(w.win_amount)),
    )
    listed = F.when(F.size(winners) > 0, winner_lines).otherwise(F.array(F.lit(dims.NO_WINNERS)))
    header = F.array(
        line("开奖号：", F.coalesce(two_digits(special), F.lit(""))),
        line("开奖生肖：", draw_zodiac),
        line("总赌注金额：", plain_number(total["total_bet_amount"])),
        line("总中奖金额：", plain_number(total["total_win_amount"])),
        line("投注组数：", total["group_count"].cast("string")),
        line("投注号码数：", total["entry_count"].cast("string")),
        F.lit("中奖名单："),
    )
    return F.array_join(F.concat(header, listed), "\n")


def reports(slips: DataFrame, keys: tuple[str, ...] = ("slip_id",)) -> DataFrame:
    """One report per wide slip with groups, winners and draw inputs. Map-only."""
    winners = F.concat(*[F.col(f"winners_{mode}") for mode in dims.MODES])
    with_totals = slips.withColumn("total", slip_totals()).withColumn("winners", winners)
    text = report_text(F.col("total"), F.col("winners"), F.col("special"), F.col("draw_zodiac"))
    return with_totals.select(*keys, text.alias("report"))
