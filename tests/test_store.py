"""The versioned store, and the status that a sync's own progress gives."""

import random
from datetime import datetime, timedelta

import pytest

from slipspark.session import shared_dir
from slipspark.sources import store as st
from slipspark.streaming import draw_sync, progress
from tests.test_arriving import _files
from tests.test_feeds import GOOD

ROWS = "lottery string, at bigint, issue string"


def _store(spark):
    return st.Store(spark, shared_dir(spark, "store"), ["lottery"], ["at"])


def _table(frame):
    return None if frame is None else sorted((r.lottery is None, r.lottery, r.at, r.issue) for r in frame.collect())


def _newest(rows):
    out = {}
    for lottery, at, issue in rows:
        out[lottery] = max(out.get(lottery, (at, issue)), (at, issue))
    return sorted((k is None, k, *v) for k, v in out.items())


def test_newest_rows_over_many_commits(spark):
    rng = random.Random(8)
    store, all_rows, pinned = _store(spark), [], {}
    assert store.read() is None and store.version() is None
    for batch in range(20):
        rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(1000), f"i{rng.randrange(50)}") for _ in range(rng.randrange(1, 5))]
        all_rows += rows
        number = store.commit(spark.createDataFrame(rows, ROWS), batch)
        assert number == batch + 1 and len(store.version().folders) < st.COMPACT
        pinned[number] = _newest(all_rows)
    assert _table(store.read()) == pinned[20]
    assert all(_table(store.read(n)) == pinned[n] for n in (1, 7, 8, 13, 20))
    gone = store.vacuum(2)
    assert gone and store.versions() == [19, 20] and _table(store.read()) == pinned[20] and _table(store.read(19)) == pinned[19]
    assert store.vacuum(2) == []
    with pytest.raises(LookupError):
        store.read(3)
    # what is read doesn't grow: folders named by the last version, and files below data/
    assert len(store._names("data")) <= 2 * st.COMPACT


def test_a_repeated_batch_changes_nothing(spark):
    store = _store(spark)
    store.commit(spark.createDataFrame([("a", 1, "x")], ROWS), 0)
    store.commit(spark.createDataFrame([("a", 2, "y")], ROWS), 1)
    assert store.commit(spark.createDataFrame([("a", 9, "never")], ROWS), 1) == 2
    assert _table(store.read()) == [(False, "a", 2, "y")]


@pytest.mark.parametrize("commits", [3, st.COMPACT - 1])
def test_a_crash_between_any_two_steps(spark, monkeypatch, commits):
    """Rows written but not named by a manifest, and a manifest staged but not moved: the old version stands, the batch can be repeated."""
    store = _store(spark)
    for batch in range(commits):
        store.commit(spark.createDataFrame([("a", batch, f"i{batch}")], ROWS), batch)
    before = _table(store.read())
    more = spark.createDataFrame([("a", 99, "new"), ("b", 1, "x")], ROWS)

    def crash(*_):
        raise RuntimeError("lost")

    publish = st.Store._publish
    monkeypatch.setattr(st.Store, "_publish", crash)
    with pytest.raises(RuntimeError):
        store.commit(more, commits)
    assert _table(store.read()) == before
    monkeypatch.setattr(st.Store, "_publish", publish)
    again = st.Store(spark, store.path, ["lottery"], ["at"])
    staged = again._path(f"{again.path}/manifests/.left")
    again._files.create(staged).close()
    assert again.commit(more, commits) == commits + 1
    assert _table(again.read()) == [(False, "a", 99, "new"), (False, "b", 1, "x")]
    assert len(again.vacuum(1)) >= 1 and _table(again.read()) == [(False, "a", 99, "new"), (False, "b", 1, "x")]


def test_two_writers_do_not_overwrite_each_other(spark):
    one = _store(spark)
    two = st.Store(spark, one.path, ["lottery"], ["at"])
    one.commit(spark.createDataFrame([("a", 1, "x")], ROWS), 0)
    stale = two.version()
    one.commit(spark.createDataFrame([("a", 2, "y")], ROWS), 1)
    with pytest.raises(RuntimeError):
        two._publish(st.Version(stale.number + 1, 1, stale.folders, stale.schema))
    assert _table(one.read()) == [(False, "a", 2, "y")]


def _sync(spark, feed, out, listener):
    spark.streams.addListener(listener)
    try:
        query = draw_sync.sync_to_store(feed, out, listener.name, interval=None)
        try:
            query.awaitTermination()
        finally:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def test_status_with_an_injected_failure(spark, monkeypatch):
    start = datetime(2024, 1, 10)
    payloads = [GOOD, "<html>", GOOD.replace("2024010", "2024011"), '{"code":0,"msg":"busy","data":[]}']
    schema = "lottery_type string, ts timestamp, payload string"
    out = shared_dir(spark, "status")
    feed = _files(spark, [("am", start + timedelta(minutes=i), p) for i, p in enumerate(payloads)], schema, f"{out}/in", 4)
    listener = progress.SyncListener("sync-under-test")
    commit = st.Store.commit

    def failing(self, rows, batch):
        if batch == 2:
            raise OSError("no room left")
        return commit(self, rows, batch)

    monkeypatch.setattr(st.Store, "commit", failing)
    with pytest.raises(Exception, match="no room left"):
        _sync(spark, feed, out, listener)
    s = listener.status
    assert (s.attempts, s.successes, s.batches, s.failed) == (2, 1, 2, True) and "no room left" in s.last_error
    assert draw_sync.draw_store(spark, out).read().first().issue == "2024010"
    monkeypatch.setattr(st.Store, "commit", commit)
    _sync(spark, feed, out, listener)  # goes on with the batch that failed
    s = listener.status
    assert (s.attempts, s.successes, s.batches, s.failed, s.last_error) == (4, 2, 4, False, "busy")
    assert s.last_attempt - s.last_success == 60_000_000
    assert draw_sync.draw_store(spark, out).read().first().issue == "2024011"
    row = progress.status_row(spark, s).first()
    assert (row.attempts, row.successes, row.last_error, row.failed) == (4, 2, "busy", False)
    assert row.last_attempt_at == start + timedelta(minutes=3) and row.last_success_at == start + timedelta(minutes=2)
