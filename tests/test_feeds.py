"""Feed, previous-row and admission logic on small inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slipspark.operators import admission as ad
from slipspark.operators import draws as dr
from slipspark.operators.ordered import with_previous
from slipspark.session import shared_dir
from slipspark.sources.sinks import read_latest, write_latest
from slipspark.streaming import draw_sync

GOOD = '{"code":1,"data":[{"id":7,"year":"2024","qishu":2024010,"date":"2024-01-10","num":"1, 02,3,04,5,06,49","shengxiao":"马,蛇,龙,兔,虎,牛,马","wuxing":"金","nqi":2024011},{"qishu":1}]}'
PAYLOADS = {
    GOOD: None,
    GOOD.replace("49", "50"): "源站返回的开奖数据不完整",
    GOOD.replace('"qishu":2024010', '"qishu":null'): "源站返回的开奖数据不完整",
    GOOD.replace('"code":1', '"code":0'): "源站没有返回最新开奖数据",
    '{"code":0,"msg":"busy","data":[]}': "busy",
    '{"code":1,"data":[]}': "源站没有返回最新开奖数据",
    "<html>": "源站返回的不是 JSON：<html>",
    "x" * 200: "源站返回的不是 JSON：" + "x" * 120,
    "": "源站返回的不是 JSON：",
    "null": "源站没有返回最新开奖数据",
}


def _feed(spark, payloads):
    start = datetime(2024, 1, 10)
    rows = [("am", start + timedelta(minutes=i), p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "lottery_type string, ts timestamp, payload string")


def test_normalize(spark):
    rows = dr.normalize(_feed(spark, PAYLOADS)).orderBy("synced_at").collect()
    assert [r.error for r in rows] == list(PAYLOADS.values())
    first = rows[0]
    assert (first.issue, first.date, first.year, first.id, first.next_issue) == ("2024010", "2024-01-10", 2024, "7", "2024011")
    assert (first.normal_numbers, first.special, first.special_zodiac, first.special_element) == ([1, 2, 3, 4, 5, 6], 49, "马", "")


def test_new_issue_compares_with_the_sync_before(spark):
    payloads = [GOOD.replace("2024010", i) for i in ("1", "1", "2", "1")]
    marked = dr.with_new_issue(dr.accepted(dr.normalize(_feed(spark, payloads)))).orderBy("synced_at").collect()
    assert [r.is_new_issue for r in marked] == [True, False, True, True]


def test_changed_draw(spark):
    payloads = [GOOD, GOOD, GOOD.replace("马,蛇,龙,兔,虎,牛,马", "马,蛇,龙,兔,虎,牛,羊"), GOOD.replace("2024010", "2")]
    marked = dr.with_changed(dr.accepted(dr.normalize(_feed(spark, payloads)))).orderBy("synced_at").collect()
    assert [(r.is_changed, r.zodiac_mismatch) for r in marked] == [(True, False), (False, False), (True, True), (True, False)]


def test_previous_over_buckets(spark):
    rng = random.Random(3)
    rows = sorted((rng.choice("aab"), rng.randint(0, 1000), i) for i in range(300))
    df = spark.createDataFrame(rows, "k string, t int, i int")
    marked = with_previous(df, ["k"], ["t", "i"], F.struct("i"), F.floor(F.col("t") / 50))
    last, want = {}, {}
    for k, _, i in rows:
        want[k, i] = last.get(k)
        last[k] = i
    assert {(r.k, r.i): r.previous.i if r.previous else None for r in marked.collect()} == want


def _brute(rows, most, window):
    recent, out = {}, {}
    for client, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        kept = [x for x in recent.get(client, []) if t - x < window]
        out[i] = len(kept) < most
        recent[client] = kept + [t] if out[i] else kept
    return out


def test_admission_against_brute_force(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    for most, window in ((1, 10), (3, 10), (4, 25)):
        # One client sends most of the requests; the rest come and go.
        rows = [(1, rng.randint(0, 400), i) for i in range(300)]
        rows += [(rng.randint(2, 9), rng.choice([0, 100, 200]) + int(rng.expovariate(0.1)), 300 + i) for i in range(300)]
        df = spark.createDataFrame(
            [(c, start + timedelta(seconds=t), i) for c, t, i in rows], "client int, ts timestamp, request_id int"
        )
        got = {r.request_id: r.admitted for r in ad.admit(df, most, window * 1_000_000).collect()}
        assert got == _brute(rows, most, window)


def test_admission_of_a_client_that_never_pauses(spark):
    """One run cut into many chunks gives what one walk gives, for even and for uneven traffic."""
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    even = [(1, t, t) for t in range(120)]
    uneven = [(2, t, 1000 + i) for i, t in enumerate(sorted(rng.randint(0, 300) for _ in range(400)))]
    df = spark.createDataFrame(
        [(c, start + timedelta(seconds=t), i) for c, t, i in even + uneven], "client int, ts timestamp, request_id int"
    )
    got = {r.request_id: r.admitted for r in ad.admit(df, 2, 10_000_000, chunk_rows=60).collect()}
    assert got == _brute(even + uneven, 2, 10)


def test_trailing_counts(spark):
    start = datetime(2024, 1, 1)
    times = [0, 1, 9, 10, 11, 30, 30]
    df = spark.createDataFrame([(1, start + timedelta(seconds=t), i) for i, t in enumerate(times)], "client int, ts timestamp, request_id int")
    got = {r.request_id: r.trailing for r in ad.trailing_counts(df, 10_000_000).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 2}


def test_latest_store(spark, tmp_path):
    assert read_latest(spark, str(tmp_path / "none")) is None
    newest = dr.latest(dr.normalize(_feed(spark, [GOOD, GOOD.replace("2024010", "2")])))
    write_latest(newest, str(tmp_path / "latest"))
    assert read_latest(spark, str(tmp_path / "latest")).first().issue == "2"


def test_sync_over_batches(spark, tmp_path):
    """Two files, two batches: the newest draw carries over, and status names the last error."""
    from slipspark.sources.feeds import stream_feed

    source, out = str(tmp_path / "feed"), shared_dir(spark, "sync")
    for part in ([GOOD, "<html>"], [GOOD.replace('"code":1', '"code":0')]):
        _feed(spark, part).coalesce(1).write.mode("append").json(source)
    query = draw_sync.sync(stream_feed(spark, source, files_per_trigger=1), out, interval=None)
    query.awaitTermination()
    assert draw_sync.polls(spark, out).count() == 3
    assert [r.issue for r in draw_sync.newest(spark, out).collect()] == ["2024010"]
    assert draw_sync.sync_status(spark, out).first().last_error == "源站返回的不是 JSON：<html>"
