"""How a sync is going, told by the query itself: a listener reads each batch's observed metrics, so no poll is read again.

A batch that fails never comes to count; its error is what the query ended with, and stays until a later batch succeeds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "sync"


def observed(polls: DataFrame) -> DataFrame:
    """Normalised polls that report, per batch: attempts, successes, when, and the error of the last attempt."""
    good = F.col("error").isNull()
    return polls.observe(
        METRICS,
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(good, 1)).alias("successes"),
        F.max(F.unix_micros("synced_at")).alias("last_attempt"),
        F.max(F.when(good, F.unix_micros("synced_at"))).alias("last_success"),
        F.max(F.struct(F.unix_micros("synced_at"), F.coalesce("error", F.lit("")))).alias("last"),
    )


@dataclass(frozen=True)
class Status:
    attempts: int = 0
    successes: int = 0
    last_attempt: int | None = None  # microseconds
    last_success: int | None = None
    last_error: str = ""  # of the last attempt, or what ended the query
    batches: int = 0
    failed: bool = False


class SyncListener(StreamingQueryListener):
    """Status of the query of one name, over its restarts."""

    def __init__(self, name: str):
        self.name, self._status, self._lock, self._ids = name, Status(), Lock(), set()

    @property
    def status(self) -> Status:
        with self._lock:
            return self._status

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            with self._lock:
                self._ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(METRICS) if progress.name == self.name else None
        if row is None or not row["attempts"]:
            return
        with self._lock:
            s = self._status
            later = lambda a, b: b if a is None else a if b is None else max(a, b)
            error = row["last"][1] if s.last_attempt is None or row["last"][0] is None or row["last"][0] >= s.last_attempt else s.last_error
            self._status = Status(
                s.attempts + row["attempts"], s.successes + row["successes"], later(s.last_attempt, row["last_attempt"]),
                later(s.last_success, row["last_success"]), error, s.batches + 1, False,
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._ids and event.exception:
            with self._lock:
                self._status = replace(self._status, last_error=event.exception, failed=True)


def status_row(spark: SparkSession, status: Status) -> DataFrame:
    row = (status.last_attempt, status.last_success, status.attempts, status.successes, status.last_error, status.failed)
    frame = spark.createDataFrame([row], "last_attempt bigint, last_success bigint, attempts bigint, successes bigint, last_error string, failed boolean")
    return frame.select(F.timestamp_micros("last_attempt").alias("last_attempt_at"), F.timestamp_micros("last_success").alias("last_success_at"), "attempts", "successes", "last_error", "failed")
