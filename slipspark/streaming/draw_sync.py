"""Draw sync: polls of the feed in, accepted draws and the newest draw per lottery out.

The micro-batch engine runs one batch at a time, which is the single flight the sync needs. A batch writes to folders of
its own, so one that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slipspark import dims
from slipspark.operators import draws as dr
from slipspark.sources.sinks import read_batch, write_batch
from slipspark.sources.store import Store
from slipspark.streaming.progress import observed


def _newest(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    known = batch if stored is None else batch.unionByName(stored)
    return dr.latest(known)


def sync(feed: DataFrame, out: str, interval: str | None = dims.POLL_INTERVAL) -> StreamingQuery:
    """Start the sync; with ``interval`` None it takes what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        polls = dr.normalize(batch)
        write_batch(polls, f"{out}/polls", batch_id)
        # Read back what was written, so the feed is parsed once for both tables.
        written = read_batch(spark, f"{out}/polls", batch_id)
        write_batch(_newest(written, read_batch(spark, f"{out}/latest", batch_id - 1)), f"{out}/latest", batch_id)

    writer = feed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    paced = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return paced.start()


def sync_to_store(feed: DataFrame, out: str, name: str, interval: str | None = dims.POLL_INTERVAL) -> StreamingQuery:
    """Start a sync whose newest draws are a versioned ``store`` and whose batches report to a ``progress.SyncListener`` of its name."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{out}/polls", batch_id)
        written = read_batch(batch.sparkSession, f"{out}/polls", batch_id)
        draw_store(batch.sparkSession, out).commit(dr.accepted(written), batch_id)

    writer = observed(dr.normalize(feed)).writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", f"{out}/checkpoint")
    paced = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return paced.start()


def draw_store(spark: SparkSession, out: str) -> Store:
    """The newest accepted draw per lottery."""
    return Store(spark, f"{out}/store", ["lottery_type"], ["synced_at", "issue"])


def polls(spark: SparkSession, out: str) -> DataFrame:
    """All polls, rejected ones with their error."""
    return spark.read.parquet(f"{out}/polls").drop("batch")


def newest(spark: SparkSession, out: str) -> DataFrame:
    """Newest draw per lottery after the last complete batch."""
    stored = spark.read.parquet(f"{out}/latest")
    rest = [c for c in stored.columns if c not in ("lottery_type", "batch")]
    last = stored.groupBy("lottery_type").agg(F.max_by(F.struct(*rest), "batch").alias("d"))
    return last.select("lottery_type", "d.*")


def sync_status(spark: SparkSession, out: str) -> DataFrame:
    """Attempts, successes and the error of the last attempt (none once one has succeeded), from the polls so far."""
    return polls(spark, out).agg(
        F.max("synced_at").alias("last_attempt_at"),
        F.max(F.when(F.col("error").isNull(), F.col("synced_at"))).alias("last_success_at"),
        F.count("*").alias("attempts"),
        F.count_if(F.col("error").isNull()).alias("successes"),
        F.max_by(F.struct("error"), "synced_at").alias("last"),
    ).select("last_attempt_at", "last_success_at", "attempts", "successes", F.col("last.error").alias("last_error"))
