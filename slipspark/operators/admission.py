"""Request admission: at most ``max_requests`` admitted requests per client in any trailing window.

A refused request does not count, so admission depends on earlier decisions and needs a pass in time order. What it
does not need is a client's whole history. Cut time into buckets of one window length. Where two neighbouring buckets
together hold no more than ``max_requests``, everything in the later one is admitted; such a bucket also tells the next
one exactly what is still in its window. Only runs of fuller buckets, the busy runs, are walked in order.

A client that is busy all the time is one long run, so runs are cut into chunks of bounded size that are walked in
parallel. A chunk starts from what the chunk before admitted in its last bucket. The first round guesses that nothing
was; each further round walks again, and writes, only the chunks whose start turned out different, until none does. That
is exact, since the first chunk of a run is right at once and every round settles at least one more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipspark import dims
from slipspark.session import shared_dir

# Requests of a busy run walked by one task.
CHUNK_ROWS = 1_000_000
_TIME = "_t"
# Fixed value: the key of requests that name no client.
UNKNOWN = "unknown"


def _timed(requests: DataFrame, window_us: int) -> DataFrame:
    return requests.withColumn(_TIME, F.unix_micros("ts")).withColumn("_b", F.floor(F.col(_TIME) / F.lit(window_us)))


def trailing_counts(requests: DataFrame, window_us: int, name: str = "trailing") -> DataFrame:
    """Requests plus how many of the client's requests, this one included, lie within the trailing window.

    Each request also visits the following bucket as context, so a window never reaches outside its bucket and a hot
    client is split by time.
    """
    timed = _timed(requests, window_us)
    visits = timed.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", F.col("_b") + F.col("_ahead"))
    frame = Window.partitionBy("client", "_b").orderBy(_TIME).rangeBetween(-(window_us - 1), 0)
    counted = visits.withColumn(name, F.count("*").over(frame)).filter("_ahead = 0")
    return counted.select(*requests.columns, name)


def busy_runs(requests: DataFrame, max_requests: int, window_us: int, chunk_rows: int) -> DataFrame:
    """One row per client and bucket: whether it is heavy, its run and chunk, and the run it leads into if it is not."""
    counts = _timed(requests, window_us).groupBy("client", "_b").agg(F.count("*").alias("_n"))
    by_time = Window.partitionBy("client").orderBy("_b")
    adjacent = lambda offset: F.lag("_b", offset).over(by_time) == F.col("_b") - offset
    before = F.when(adjacent(1), F.lag("_n").over(by_time)).otherwise(F.lit(0))
    weighed = counts.withColumn("heavy", F.col("_n") + F.coalesce(before, F.lit(0)) > max_requests)
    continues = F.col("heavy") & F.coalesce(adjacent(1) & F.lag("heavy").over(by_time), F.lit(False))
    marked = weighed.withColumn("_start", F.when(F.col("heavy") & ~continues, F.col("_b")))
    running = by_time.rowsBetween(Window.unboundedPreceding, 0)
    with_run = marked.withColumn("run", F.when(F.col("heavy"), F.max("_start").over(running)))
    leads = F.coalesce(F.lead("_b").over(by_time) == F.col("_b") + 1, F.lit(False))
    feeds = F.when(~F.col("heavy") & leads & F.lead("heavy").over(by_time), F.lead("run").over(by_time))
    filled = F.sum("_n").over(Window.partitionBy("client", "run").orderBy("_b")) - F.col("_n")
    chunk = F.when(F.col("heavy"), F.floor(filled / F.lit(chunk_rows)))
    cut = with_run.withColumn("feeds", feeds).withColumn("chunk", chunk)
    next_chunk = F.lead("chunk").over(Window.partitionBy("client", "run").orderBy("_b"))
    # Set on the last bucket of a chunk: the chunk that starts right after it.
    opens = F.when(F.col("heavy") & (next_chunk != F.col("chunk")), next_chunk)
    return cut.withColumn("opens", opens).select("client", "_b", "heavy", "run", "chunk", "feeds", "opens")


def walk(batches: Iterator[pd.DataFrame], max_requests: int, window_us: int) -> Iterator[pd.DataFrame]:
    """Decide requests sorted by chunk and time; holds the last ``max_requests`` admitted times of one chunk.

    A full window opens again when its oldest member leaves it, so the walk jumps there: its work is in the admitted
    requests. Seed rows are requests admitted before the chunk; they take their place in the window.
    """
    key, recent = None, deque(maxlen=max_requests)
    for batch in batches:
        admitted = np.zeros(len(batch), bool)
        times, seeds = batch[_TIME].to_numpy(np.int64), batch["seed"].to_numpy(bool)
        keys = list(zip(batch["client"], batch["run"], batch["chunk"]))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        for first, last in zip(starts, [*starts[1:], len(keys)]):
            if keys[first] != key:
                key = keys[first]
                recent.clear()
            i = first
            while i < last:
                if seeds[i] or len(recent) < max_requests or times[i] - recent[0] >= window_us:
                    admitted[i] = True
                    recent.append(times[i])
                    i += 1
                else:
                    i += int(np.searchsorted(times[i:last], recent[0] + window_us))
        yield batch.assign(admitted=admitted)


_CHUNK = ["client", "run", "chunk"]
_SEED = [*_CHUNK, _TIME, "request_id"]
_ROW = [*_SEED, "ts", "opens", "seed"]


def _walked(rows: DataFrame, seeds: DataFrame, max_requests: int, window_us: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{name} {types[name]}" for name in _ROW) + ", admitted boolean"
    started = seeds.select(*_SEED).withColumns(
        {"ts": F.lit(None).cast(types["ts"]), "opens": F.lit(None).cast(types["opens"]), "seed": F.lit(True)}
    )
    ordered = (
        rows.select(*_ROW)
        .unionByName(started.select(*_ROW))
        .repartition(*_CHUNK)
        .sortWithinPartitions(*_CHUNK, _TIME, "request_id")
    )
    decided = ordered.mapInPandas(lambda batches: walk(batches, max_requests, window_us), schema)
    return decided.filter("NOT seed")


def _handed(decided: DataFrame) -> DataFrame:
    """What each chunk hands to the next: its admitted requests of the last bucket, at most ``max_requests``."""
    admitted = F.collect_list(F.when(F.col("admitted"), F.struct(_TIME, "request_id")))
    ends = decided.filter("opens IS NOT NULL").withColumn("chunk", F.col("opens"))
    return ends.groupBy(*_CHUNK).agg(F.array_sort(admitted).alias("state"))


def admit(
    requests: DataFrame,
    max_requests: int = dims.ADMIT_MAX,
    window_us: int = dims.ADMIT_WINDOW_MS * 1000,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Requests (client, ts, request_id) plus ``admitted``; ties in time go by request_id.

    Requests without a client share the budget of the client ``UNKNOWN``.
    """
    spark = requests.sparkSession
    client = requests.schema["client"].dataType
    requests = requests.withColumn("client", F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN)))
    out = shared_dir(spark, "admission")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    given = F.col("client") if client.simpleString() == "string" else F.col("client").try_cast(client)
    shown = [given.alias("client"), "ts", "request_id", "admitted"]
    runs = stored(busy_runs(requests, max_requests, window_us, chunk_rows), "runs")
    placed = _timed(requests, window_us).join(runs, ["client", "_b"])
    quiet = placed.filter("NOT heavy").withColumn("admitted", F.lit(True)).select(*shown)
    # A quiet bucket that leads into a run seeds its first chunk: its requests are admitted and occupy the window.
    context = placed.filter("feeds IS NOT NULL").withColumn("run", F.col("feeds")).withColumn("chunk", F.lit(0).cast("bigint"))
    heavy = placed.filter("heavy").withColumn("seed", F.lit(False))
    if runs.filter("opens IS NOT NULL").isEmpty():
        return _walked(heavy, context, max_requests, window_us).select(*shown).unionByName(quiet)

    heavy = stored(heavy.select(*_ROW), "heavy")
    decided = stored(_walked(heavy, context, max_requests, window_us), "rounds/turn=0")
    handed = stored(_handed(decided), "handed/turn=0")
    dirty, turn = stored(handed.filter("size(state) > 0"), "dirty-0"), 0
    while not dirty.isEmpty():
        turn += 1
        seeds = dirty.select(*_CHUNK, F.explode("state").alias("s")).select(*_CHUNK, F.col(f"s.{_TIME}").alias(_TIME), "s.request_id")
        # Only a later chunk can be handed something new, so context, which seeds first chunks, is not needed again.
        again = _walked(heavy.join(dirty, _CHUNK, "left_semi"), seeds, max_requests, window_us)
        again = stored(again, f"rounds/turn={turn}")
        before = spark.read.parquet(f"{out}/handed").groupBy(*_CHUNK).agg(F.max_by("state", "turn").alias("before"))
        changed = _handed(again).join(before, _CHUNK, "left").filter("NOT state <=> before").drop("before")
        dirty = stored(changed, f"dirty-{turn}")
        dirty.write.parquet(f"{out}/handed/turn={turn}")
    every = spark.read.parquet(f"{out}/rounds")
    last = every.groupBy(*_CHUNK).agg(F.max("turn").alias("turn"))
    return every.join(last, [*_CHUNK, "turn"]).select(*shown).unionByName(quiet)
