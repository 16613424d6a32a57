"""Queries that settle all slips against all draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.operators import backtest as bt
from slipspark.operators import extract as ex
from slipspark.operators import settle as st
from slipspark.plans.bets import shown
from slipspark.sources import fixtures as fx
from slipspark.sources.slips import to_long


def backtest_draws(spark: SparkSession, sf: str) -> DataFrame:
    """What all slips together would have won in each draw, per kind and play."""
    groups = ex.extract(to_long(fx.slips(spark, sf)))
    totals = bt.backtest(groups, st.draw_inputs(fx.draws(spark, sf)))
    return shown(totals.withColumn("draw_date", F.col("draw_date").cast("string")), "draw_date", "kind", "play", "stake", "win_units", "win_amount")


QUERIES = {"backtest_draws": backtest_draws}
