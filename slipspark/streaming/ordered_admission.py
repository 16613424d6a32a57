"""Request admission on a stream whose requests come out of order.

A request waits in its client's reorder buffer until the watermark has passed its time; then nothing older can come, and the
buffer is walked in time order, just as a table would be. An event-time timer per client wakes it: at its oldest waiting request, or,
with nothing waiting, when its last admitted request has left the window, which drops the client's state. So the state holds what
came within the watermark's delay and one window of admitted requests, not every client there ever was.

Requests behind the watermark are dropped by Spark; ``late.split_late`` in front keeps them in a side table. Requests without a time
go there too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from slipspark import dims
from slipspark.operators.admission import UNKNOWN

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers need; the session's own choice stays."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Admission(StatefulProcessor):
    """Times are microseconds, timers milliseconds. Request ids are texts, as whole numbers with nulls among them would reach pandas as floats."""

    def __init__(self, max_requests: int, window_us: int, whole_ids: bool):
        self.max_requests, self.window_us, self.whole_ids = max_requests, window_us, whole_ids

    def _place(self, row: tuple) -> tuple:
        """Order of a request: time, then id, a request without an id first."""
        t, request_id = row
        return t, request_id is not None, 0 if request_id is None else int(request_id) if self.whole_ids else request_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, request_id string")
        self.recent = handle.getValueState("recent", "recent array<bigint>")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def _wake(self, at: int) -> None:
        if self.alarm.exists():
            set_for = self.alarm.get()[0]
            if set_for == at:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendList(list(zip(batch["t"].tolist(), batch["request_id"].tolist())))
            first = int(batch["t"].min()) if first is None else min(first, int(batch["t"].min()))
        if first is not None:
            at = -(-first // 1000)
            # an alarm that only drops old state may be late; one for a request that waits may not
            self._wake(min(at, self.alarm.get()[0]) if self.alarm.exists() else at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((r[0], r[1]) for r in self.waiting.get()), key=self._place) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= passed]
        rest = held[len(ready) :]
        recent = deque(self.recent.get()[0] if self.recent.exists() else [])
        admitted = []
        for t, _ in ready:
            while recent and t - recent[0] >= self.window_us:
                recent.popleft()
            admitted.append(len(recent) < self.max_requests)
            if admitted[-1]:
                recent.append(t)
        while recent and not rest and passed - recent[0] >= self.window_us:  # no request to come can meet it
            recent.popleft()
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.recent.update((list(recent),)) if recent else self.recent.clear()
        if rest:
            self._wake(-(-rest[0][0] // 1000))
        elif recent:
            self._wake(-(-(recent[-1] + self.window_us) // 1000))
        if ready:
            client = [key[0]] * len(ready)
            yield pd.DataFrame({"client": client, "request_id": [r[1] for r in ready], "t": [r[0] for r in ready], "admitted": admitted})

    def close(self) -> None:
        pass


def admit_ordered(requests: DataFrame, delay: str, max_requests: int = dims.ADMIT_MAX, window_us: int = dims.ADMIT_WINDOW_MS * 1000) -> DataFrame:
    """Stream of requests (client, ts, request_id) to client, request_id, t (microseconds), admitted, a request as soon as it is certain.

    Any order within ``delay`` gives what the batch operator gives. Start the query inside ``rocks_state``. One client's requests
    of a delay and a batch are walked together; they are the smallest unit of work.
    """
    client_type = requests.schema["client"].dataType
    id_type = requests.schema["request_id"].dataType
    client = F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN)).alias("client")
    timed = requests.withWatermark("ts", delay).where(F.col("ts").isNotNull()).select(client, F.col("request_id").cast("string").alias("request_id"), "ts", F.unix_micros("ts").alias("t"))
    decided = timed.groupBy("client").transformWithStateInPandas(
        _Admission(max_requests, window_us, isinstance(id_type, IntegralType)),
        outputStructType="client string, request_id string, t bigint, admitted boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
    return decided.withColumns({"client": F.col("client").try_cast(client_type), "request_id": F.col("request_id").cast(id_type)})
