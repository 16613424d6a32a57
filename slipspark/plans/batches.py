"""Queries over recognition batches: from boxes to the settled bets of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.operators import batches as bs
from slipspark.operators import extract as ex
from slipspark.operators import ocr_table as tb
from slipspark.operators import ocr_text as ct
from slipspark.operators import settle as st
from slipspark.operators import summary as sm
from slipspark.plans.bets import SUMMARY
from slipspark.plans.images import merged
from slipspark.sources import fixtures as fx

COUNTED = ("images", "images_with_text", "numbers_found", *(f"lines_{m}" for m in dims.MODES), "said")


def _settled(wide: DataFrame, draws: DataFrame) -> DataFrame:
    dated = wide.withColumn("c", F.col("batch_id")).withColumn("draw_date", F.expr(fx.CHAT_BATCH_DAY)).withColumn("slip_id", F.col("batch_id"))
    totals = sm.all_mode_summaries(sm.with_winners(ex.with_groups(st.with_draw(dated, draws))), ("batch_id", *COUNTED))
    shown = [F.col(c).cast("double" if c in sm.AMOUNTS else "bigint").alias(c) for c in (*SUMMARY, "winner_count")]
    return totals.select("batch_id", *COUNTED, *shown)


def recognition_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of chat and of table images: texts in order, what was found, lines per bucket, and the settled bets."""
    draws = st.draw_inputs(fx.batch_draws(spark, sf))
    lines = {m: F.col(f"lines_{m}") for m in dims.MODES}
    chats = bs.chat_slips(bs.batch_texts(ct.chat_texts(fx.chat_images(spark, sf)).select("batch_id", "seq", "image_id", "text")))
    chats = _settled(chats.withColumn("said", bs.classified_text(F.col("images"), lines)), draws)
    batch_of = fx.keyed_orders(spark, sf).selectExpr("c AS batch_id", "k AS seq", "k AS image_id")
    read = batch_of.join(tb.recognised(merged(spark, sf)), "image_id", "left")
    tables = bs.table_slips(bs.batch_texts(read, F.col("numbers")))
    tables = _settled(tables.withColumn("said", bs.recognised_text(F.col("images"), F.col("numbers_found"))), draws)
    return chats.select(F.lit("chat").alias("kind"), "*").unionByName(tables.select(F.lit("table").alias("kind"), "*"))


QUERIES = {"recognition_batches": recognition_batches}
