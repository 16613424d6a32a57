"""Settling again when a draw arrives or changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slipspark.operators.settle import draw_inputs, keys_of
from slipspark.sources.sinks import read_batch, write_batch

def changed_draws(arrived: DataFrame, seen: DataFrame | None, key: str | Sequence[str] = "draw_date") -> DataFrame:
    """Draws whose special, numbers or zodiac differ from what was last settled for their key."""
    if seen is None:
        return arrived
    inputs = F.struct("special", "drawn", "draw_zodiac")
    before = seen.select(*keys_of(key), inputs.alias("_seen"))
    joined = arrived.withColumn("_now", inputs).join(before, keys_of(key), "left")
    return joined.filter("_seen IS NULL OR _now <> _seen").drop("_seen", "_now")


def resettle(
    draws: DataFrame,
    to_draws: Callable[[DataFrame], DataFrame],
    slips: DataFrame,
    settle: Callable[[DataFrame, DataFrame], DataFrame],
    out: str,
    interval: str | None = None,
    key: str | Sequence[str] = "draw_date",
) -> StreamingQuery:
    """For each batch of arriving draws, settle the slips of the changed ones with ``settle(slips, draws)``.

    Of several draws of a key in a batch the last synced one counts. Slips partitioned by the key on disk are read only
    where a draw has changed, and not at all when none has.
    """
    keys = keys_of(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = draw_inputs(to_draws(batch), keys)
        seen = read_batch(spark, f"{out}/seen", batch_id - 1)
        write_batch(changed_draws(arrived, seen, keys), f"{out}/changed", batch_id)
        changed = read_batch(spark, f"{out}/changed", batch_id)
        assert changed is not None
        if changed.isEmpty():  # nothing to settle: the slips aren't read
            if seen is not None:
                write_batch(seen, f"{out}/seen", batch_id)
                return
        kept = changed if seen is None else changed.unionByName(seen.join(changed, keys, "left_anti"))
        write_batch(kept, f"{out}/seen", batch_id)
        touched = slips.join(changed.select(*keys), keys, "left_semi")
        write_batch(settle(touched, changed), f"{out}/settled", batch_id)

    writer = draws.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    paced = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return paced.start()


def settled(spark: SparkSession, out: str, keys: tuple[str, ...]) -> DataFrame:
    """Latest result per slip; a later batch replaces an earlier one."""
    rows = spark.read.parquet(f"{out}/settled")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
