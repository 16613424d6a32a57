"""Queries over the draw feed and the request log, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.operators import admission as ad
from slipspark.operators import draws as dr
from slipspark.operators import extract as ex
from slipspark.operators import settle as st
from slipspark.operators import summary as sm
from slipspark.plans.bets import SUMMARY, shown
from slipspark.session import shared_dir
from slipspark.sources import fixtures as fx
from slipspark.sources.feeds import with_first_item
from slipspark.streaming import admission as admission_stream
from slipspark.streaming import arriving, draw_events, draw_sync, late, progress, resettle
from slipspark.streaming.ordered_admission import admit_ordered, rocks_state

# Three days and five requests: the limits bind on this log, the defaults never would.
WINDOW_US = 3 * 24 * 3600 * 1_000_000
MAX_REQUESTS = 5


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def draw_feed_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_first_item(fx.feed(spark, sf))
    error = F.coalesce("error", F.lit("")).alias("error")
    return rows.groupBy("lottery_type", error, F.col("item.qishu").alias("issue")).agg(F.count("*").alias("polls"))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return dr.normalize(fx.feed(spark, sf))


def _accepted_once(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted polls as a table: what compares rows with rows before reads it more than once, the feed is parsed once."""
    path = shared_dir(spark, "accepted")
    dr.accepted(_normalized(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def draw_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select(
        "event_id",
        "lottery_type",
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("error").isNull(), F.array_join("normal_numbers", ".")).alias("normal_numbers"),
        F.when(F.col("error").isNull(), F.col("special").cast("bigint")).alias("special"),
        F.when(F.col("error").isNull(), F.col("special_zodiac")).alias("special_zodiac"),
        F.when(F.col("error").isNull(), F.col("special_element")).alias("special_element"),
        F.when(F.col("error").isNull(), F.col("next_issue")).alias("next_issue"),
    )


def draw_latest(spark: SparkSession, sf: str) -> DataFrame:
    newest = dr.latest(_normalized(spark, sf).drop("event_id"))
    return _draw_shown(newest)


def _draw_shown(rows: DataFrame) -> DataFrame:
    return rows.select("lottery_type", "issue", "date", F.array_join("numbers", ".").alias("numbers"), _stamp("synced_at"))


def draw_new_issue(spark: SparkSession, sf: str) -> DataFrame:
    good = _accepted_once(spark, sf)
    marked = dr.with_new_issue(good, ("synced_at", "event_id"))
    return marked.filter("is_new_issue").select("event_id", "lottery_type", "issue")


def draw_changed(spark: SparkSession, sf: str) -> DataFrame:
    good = _accepted_once(spark, sf)
    marked = dr.with_changed(good, ("synced_at", "event_id"))
    return marked.groupBy("lottery_type", "issue").agg(
        F.count_if("is_changed").alias("changes"), F.count_if("zodiac_mismatch").alias("mismatches"), F.count("*").alias("polls")
    )


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The given table as a stream of files, a bounded number per batch."""
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/{name}.parquet*")


def _dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows of a stream dealt evenly: a file of few large row groups is read by few tasks, however many cores there are."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def draw_sync_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_dir(spark, "draw-sync")
    feed = fx.feed_from(_stream(spark, sf, "events")).drop("event_id")
    draw_sync.sync(feed, out, interval=None).awaitTermination()
    return _draw_shown(draw_sync.newest(spark, out))


def draw_sync_status(spark: SparkSession, sf: str) -> DataFrame:
    """How the sync of the streamed feed went."""
    out = shared_dir(spark, "draw-sync")
    feed = fx.feed_from(_stream(spark, sf, "events")).drop("event_id")
    draw_sync.sync(feed, out, interval=None).awaitTermination()
    status = draw_sync.sync_status(spark, out)
    return status.select(_stamp("last_attempt_at"), _stamp("last_success_at"), "attempts", "successes", F.coalesce("last_error", F.lit("")).alias("last_error"))


def feed_settle(spark: SparkSession, sf: str) -> DataFrame:
    """Slips settled with the draws that came through the feed, the last accepted poll of a lottery and day counting."""
    keys = ["lottery_type", "date"]
    draws = st.draw_inputs(dr.accepted(_normalized(spark, sf)).drop("event_id"), keys)
    drawn = st.with_draw(fx.lottery_slips(spark, sf), draws, keys)
    totals = sm.all_mode_summaries(sm.with_winners(ex.with_groups(drawn)), ("slip_id", *keys))
    return shown(totals, "slip_id", *keys, *SUMMARY, "winner_count")


def _settle(slips: DataFrame, draws: DataFrame) -> DataFrame:
    drawn = st.with_draw(slips, draws)
    return sm.all_mode_summaries(sm.with_winners(ex.with_groups(drawn)), ("slip_id", "draw_date"))


def resettle_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_dir(spark, "resettle")
    draws = _stream(spark, sf, "orders")
    resettle.resettle(draws, fx.draws_from, fx.slips(spark, sf), _settle, out).awaitTermination()
    return shown(resettle.settled(spark, out, ("slip_id",)), "slip_id", *SUMMARY, "winner_count")


def trailing_requests(spark: SparkSession, sf: str) -> DataFrame:
    counted = ad.trailing_counts(fx.requests(spark, sf), WINDOW_US)
    return counted.select("client", "request_id", "trailing")


def admission(spark: SparkSession, sf: str) -> DataFrame:
    decided = ad.admit(fx.requests(spark, sf), MAX_REQUESTS, WINDOW_US)
    return decided.select("client", "request_id", "admitted")


def admission_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same log through the stateful stream."""
    out = shared_dir(spark, "admission")
    requests = _stream(spark, sf, "events").selectExpr(*fx.REQUEST)
    decided = admission_stream.admit_stream(requests, MAX_REQUESTS, WINDOW_US)
    query = (
        decided.writeStream.format("parquet")
        .option("path", f"{out}/decided")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/decided").select("client", "request_id", "admitted")


def _settle_met(slips: DataFrame) -> DataFrame:
    return sm.all_mode_summaries(sm.with_winners(ex.with_groups(slips)), ("slip_id", "draw_date", "synced_at"))


def resettle_join_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Slips that arrive before and after their draws, both as streams; slips that never meet a draw included."""
    out = shared_dir(spark, "arriving")
    orders = _stream(spark, sf, "orders")
    slips = fx.slips_from(fx.keyed_from(orders), fx.ARRIVED)
    dated = orders.selectExpr("cast(o_orderdate AS date) AS draw_date").selectExpr("draw_date", fx.SYNCED)
    draws = fx.draws_of(dated.withWatermark("synced_at", "3650 days").dropDuplicates(["draw_date", "synced_at"]), "synced_at")
    arriving.arrive(slips, "arrived_at", "1 day", f"{out}/slips").awaitTermination()
    arriving.arrive(draws, "synced_at", "1 day", f"{out}/draws").awaitTermination()
    ins = (spark, f"{out}/slips", f"{out}/draws")
    arriving.settle_arriving(*ins, slips.schema, draws.schema, _settle_met, f"{out}/met", "1 day", "4 days").awaitTermination()
    return shown(arriving.results(*ins, _settle_met, f"{out}/met", "4 days"), "slip_id", *SUMMARY, "winner_count")


def _synced(spark: SparkSession, sf: str, files: int = 12) -> tuple[str, progress.Status]:
    """The feed in ``files`` files by time, synced file by file into a store, and how that went."""
    out = shared_dir(spark, "draw-store")
    fx.feed(spark, sf).drop("event_id").repartitionByRange(files, "ts").write.parquet(f"{out}/feed")
    schema = spark.read.parquet(f"{out}/feed").schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/feed")
    listener = progress.SyncListener(out)
    spark.streams.addListener(listener)
    try:
        draw_sync.sync_to_store(feed, out, out, interval=None).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch has been reported
    finally:
        spark.streams.removeListener(listener)
    return out, listener.status


def draw_store(spark: SparkSession, sf: str) -> DataFrame:
    """Newest draws from the store's last version."""
    out, _ = _synced(spark, sf)
    return _draw_shown(draw_sync.draw_store(spark, out).read())


def sync_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The status that the query's own progress gives."""
    _, status = _synced(spark, sf)
    return progress.status_row(spark, status).select(_stamp("last_attempt_at"), _stamp("last_success_at"), "attempts", "successes", "last_error")


def draw_events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """New issues and changes per lottery and issue, from the streamed feed; a poll from the future releases the last ones."""
    out = shared_dir(spark, "draw-events")
    polls = fx.feed_from(_dealt(_stream(spark, sf, "events").select("event_id", "event_type", "ts")))
    end = fx.feed(spark, sf).groupBy().agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    draw = '{"code":1,"data":[{"qishu":0,"date":"-","num":"1,2,3,4,5,6,7"}]}'  # a draw, as rejected polls don't move the watermark
    end = end.select(F.lit(0).cast("bigint").alias("event_id"), F.lit("end").alias("lottery_type"), "ts", F.lit(draw).alias("payload"))
    end.limit(0).write.parquet(f"{out}/end")
    both = polls.unionByName(spark.readStream.schema(end.schema).parquet(f"{out}/end"))
    events = draw_events.draw_events(dr.normalize(both), "1 hour", "event_id")
    writer = events.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/checkpoint")
    for last in (False, True):
        if last:
            end.write.mode("append").parquet(f"{out}/end")
        with rocks_state(spark):
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    counted = spark.read.parquet(f"{out}/events").where("lottery_type <> 'end'").groupBy("lottery_type", "issue")
    return counted.agg(F.count_if("is_new_issue").alias("new_issues"), F.count_if("is_changed").alias("changes"), F.count("*").alias("polls"))


def admission_late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream whose requests may be an hour late; one request from the future ends it and releases the last ones."""
    out = shared_dir(spark, "ordered-admission")
    requests = _stream(spark, sf, "events").selectExpr(*fx.REQUEST)
    schema = requests.schema
    late.split_late(requests, "ts", "1 hour", f"{out}/log").awaitTermination()
    end = fx.requests(spark, sf).agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    end = end.select(F.lit(None).cast(schema["client"].dataType).alias("client"), "ts", F.lit(None).cast(schema["request_id"].dataType).alias("request_id"))
    end.limit(0).write.parquet(f"{out}/end")
    both = late.on_time_stream(spark, f"{out}/log", schema).unionByName(spark.readStream.schema(schema).parquet(f"{out}/end"))
    decided = admit_ordered(both, "1 hour", MAX_REQUESTS, WINDOW_US)
    writer = decided.writeStream.format("parquet").option("path", f"{out}/decided").option("checkpointLocation", f"{out}/checkpoint")
    for last in (False, True):
        if last:
            end.write.mode("append").parquet(f"{out}/end")
        with rocks_state(spark):
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{out}/decided").where("request_id IS NOT NULL").select("client", "request_id", "admitted")


QUERIES = {
    "draw_feed_parse": draw_feed_parse,
    "draw_normalize": draw_normalize,
    "draw_latest": draw_latest,
    "draw_new_issue": draw_new_issue,
    "draw_changed": draw_changed,
    "draw_sync_stream": draw_sync_stream,
    "draw_sync_status": draw_sync_status,
    "feed_settle": feed_settle,
    "resettle_stream": resettle_stream,
    "trailing_requests": trailing_requests,
    "admission": admission,
    "admission_stream": admission_streamed,
    "resettle_join_stream": resettle_join_stream,
    "admission_late_stream": admission_late_stream,
    "draw_events_stream": draw_events_stream,
    "draw_store": draw_store,
    "sync_progress": sync_progress,
}
