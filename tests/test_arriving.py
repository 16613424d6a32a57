"""Streams whose rows come late or out of order, over several micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slipspark.operators import admission as ad
from slipspark.operators import extract as ex
from slipspark.operators import settle as st
from slipspark.operators import summary as sm
from slipspark.session import shared_dir
from slipspark.streaming import arriving, late
from slipspark.streaming.ordered_admission import admit_ordered, rocks_state

START = datetime(2024, 1, 1)
SLIP = "slip_id bigint, draw_date string, arrived_at timestamp, pingma string, lianma string, fushi string"
DRAW = "draw_date string, synced_at timestamp, special int, numbers array<int>, zodiacs array<string>"


def _settle(slips):
    return sm.all_mode_summaries(sm.with_winners(ex.with_groups(slips)), ("slip_id", "draw_date", "synced_at"))


def _files(spark, rows, schema, path, batches):
    """Rows as a stream of one file per micro-batch, in the order of the rows."""
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _slips_and_draws(rng):
    day = lambda n: str((START + timedelta(days=n)).date())
    slips = []
    for i in range(60):
        d = rng.randrange(12)
        at = START + timedelta(days=d, hours=rng.uniform(-30, 30))  # before or after its draw
        slips.append((i, day(d), at, f"{rng.randint(1, 9):02d}.{rng.randint(1, 9):02d}/{rng.randint(1, 20)}", None, None))
    draws = []
    for d in range(12):
        if d in (3, 8):
            continue  # never drawn
        for again in range(1 + d % 2):  # some are synced again with another special number
            special = rng.randint(1, 9)
            draws.append((day(d), START + timedelta(days=d, hours=2 + again), special, [20, 21, 22, 23, 24, 25, special], [""]))
    return slips, draws


def _batch(spark, slips, draws, wait):
    values = st.draw_values(spark.createDataFrame(draws, DRAW), ["draw_date", "synced_at"])
    met = arriving._met(spark.createDataFrame(slips, SLIP), values, ["draw_date"], wait, "left_outer")
    rows = _settle(st.filled(met)).collect()
    best = {}
    for r in rows:
        key = (r.synced_at is not None, r.synced_at)
        if r.slip_id not in best or key > best[r.slip_id][0]:
            best[r.slip_id] = (key, (r.slip_id, r.total_bet_amount, r.total_win_amount, r.winner_count))
    return sorted(v for _, v in best.values())


@pytest.mark.parametrize("delay, slip_order, any_late", [("90 hours", "shuffled", False), ("1 hour", "shuffled", True), ("1 hour", "by time", False)])
def test_any_order_of_arrival_gives_the_batch_result(spark, delay, slip_order, any_late):
    rng = random.Random(delay + slip_order)
    slips, draws = _slips_and_draws(rng)
    want = _batch(spark, slips, draws, "40 hours")
    assert sum(w[3] for w in want) > 5
    if slip_order == "shuffled":
        rng.shuffle(slips)
        rng.shuffle(draws)
    else:
        slips.sort(key=lambda r: r[2])
        draws.sort(key=lambda r: r[1])
    out = shared_dir(spark, "arriving")
    streams = {"slips": (slips, SLIP, "arrived_at"), "draws": (draws, DRAW, "synced_at")}
    if delay == "90 hours":  # what is no more than 90 hours behind is in time
        streams = {k: (_nearly_sorted(rows, t), schema, t) for k, (rows, schema, t) in streams.items()}
    for name, (rows, schema, time) in streams.items():
        arriving.arrive(_files(spark, rows, schema, f"{out}/{name}-in", 5), time, delay, f"{out}/{name}").awaitTermination()
    args = (spark, f"{out}/slips", f"{out}/draws")
    arriving.settle_arriving(*args, SLIP, DRAW, _settle, f"{out}/settled", delay, "40 hours").awaitTermination()
    lost = late.late(spark, f"{out}/slips").count() + late.late(spark, f"{out}/draws").count()
    assert (lost > 0) == any_late
    got = arriving.results(*args, _settle, f"{out}/settled", "40 hours")
    assert sorted((r.slip_id, r.total_bet_amount, r.total_win_amount, r.winner_count) for r in got.collect()) == want


def _nearly_sorted(rows, time):
    at = {"arrived_at": 2, "synced_at": 1}[time]
    rng = random.Random(1)
    return sorted(rows, key=lambda r: r[at] + timedelta(hours=rng.uniform(0, 40)))


def test_the_join_lets_old_slips_go(spark):
    """Slips far behind the watermark leave the state, those without a draw as undrawn."""
    out = shared_dir(spark, "eviction")
    slips = [(i, str((START + timedelta(days=i)).date()), START + timedelta(days=i), "01/1", None, None) for i in range(40)]
    draws = [(str((START + timedelta(days=i)).date()), START + timedelta(days=i, hours=1), 1, [1, 2, 3, 4, 5, 6, 7], [""]) for i in range(0, 40, 2)]
    for name, rows, schema, time in (("slips", slips, SLIP, "arrived_at"), ("draws", draws, DRAW, "synced_at")):
        arriving.arrive(_files(spark, rows, schema, f"{out}/{name}-in", 4), time, "1 hour", f"{out}/{name}").awaitTermination()
    query = arriving.settle_arriving(spark, f"{out}/slips", f"{out}/draws", SLIP, DRAW, _settle, f"{out}/settled", "1 hour", "30 hours")
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(_progress, query.recentProgress) if p["stateOperators"]]
    assert kept[-1] <= 8 < max(kept)
    undrawn = spark.read.parquet(f"{out}/settled/settled").where("synced_at IS NULL").count()
    assert undrawn >= 17  # all but the last odd days have been given up


def _progress(p):
    import json

    return json.loads(p.json) if hasattr(p, "json") else p


def test_split_late_keeps_everything_and_repeats_nothing(spark):
    out = shared_dir(spark, "split")
    rows = [(i, START + timedelta(minutes=m) if m is not None else None) for i, m in enumerate([0, 50, 10, 100, 41, 38, None, 99, 200, 139, 141])]
    stream = _files(spark, rows, "id bigint, ts timestamp", f"{out}/in", 6)
    late.split_late(stream, "ts", "60 minutes", f"{out}/split").awaitTermination()
    split = lambda read: sorted(r.id for r in read(spark, f"{out}/split").collect())
    assert split(late.late) == [5, 6]  # 38 is 62 minutes behind the 100 of an earlier batch
    assert sorted(split(late.late) + split(late.on_time)) == list(range(len(rows)))
    late.split_late(stream, "ts", "60 minutes", f"{out}/split").awaitTermination()  # nothing new
    assert sorted(split(late.late) + split(late.on_time)) == list(range(len(rows)))


def _admitted(spark, rows, out, batches, delay, closing=True):
    schema = "client string, ts timestamp, request_id bigint"
    stream = _files(spark, rows, schema, f"{out}/in", batches)
    last = [("end", START + timedelta(days=3650), None)]
    if closing:
        stream = stream.unionByName(_files(spark, [("end", START - timedelta(days=1), None)], schema, f"{out}/closing", 1))

    def run():
        with rocks_state(spark):
            sink = admit_ordered(stream, delay, 3, 60_000_000).writeStream.format("parquet").option("path", f"{out}/decided")
            query = sink.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    run()
    if closing:
        spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(f"{out}/closing")
        query = run()
        state = _progress(query.recentProgress[-1])["stateOperators"][0]
    else:
        state = None
    rows = spark.read.parquet(f"{out}/decided").where("request_id IS NOT NULL")
    return sorted((r.request_id, r.client, r.admitted) for r in rows.collect()), state


def test_out_of_order_requests_are_decided_as_in_a_table(spark):
    rng = random.Random(9)
    schema = "client string, ts timestamp, request_id bigint"
    rows = [(rng.choice(["a", "a", "a", "b", None]), START + timedelta(seconds=rng.randrange(900), microseconds=rng.choice([0, 0, 1])), i) for i in range(400)]
    want = sorted((r.request_id, r.client, r.admitted) for r in ad.admit(spark.createDataFrame(rows, schema), 3, 60_000_000).collect())
    jumbled = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 100)))
    got, state = _admitted(spark, jumbled, shared_dir(spark, "jumbled"), 6, "300 seconds")
    assert got == want and 0 < sum(a for *_, a in got) < 400
    # every client but the closing one has been dropped from the state
    assert state["numRowsTotal"] <= 6


def test_a_stream_in_progress_decides_what_is_certain(spark):
    rows = [("a", START + timedelta(seconds=s), s) for s in range(0, 200, 10)]
    got, _ = _admitted(spark, rows, shared_dir(spark, "open"), 4, "50 seconds", closing=False)
    assert [i for i, *_ in got] == list(range(0, 150, 10))
