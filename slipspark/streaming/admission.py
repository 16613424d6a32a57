"""Request admission on a stream; the state of a client is the times of its admitted requests still in the window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slipspark import dims
from slipspark.operators.admission import UNKNOWN


def admit_stream(
    requests: DataFrame, max_requests: int = dims.ADMIT_MAX, window_us: int = dims.ADMIT_WINDOW_MS * 1000
) -> DataFrame:
    """Stream of requests (client, ts, request_id) plus ``admitted``.

    Batches must follow each other in time, as a request log does. The state never holds more than ``max_requests``
    times per client, and a batch's requests of a client are walked once in time order. Requests without a client share the
    budget of the client ``UNKNOWN``.
    """
    client_type = requests.schema["client"].dataType
    id_type = requests.schema["request_id"].dataType.simpleString()

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [])
        batch = pd.concat(list(batches)).sort_values(["t", "request_id"])
        decisions = []
        for t in batch["t"]:
            while recent and t - recent[0] >= window_us:
                recent.popleft()
            admit = len(recent) < max_requests
            if admit:
                recent.append(t)
            decisions.append(admit)
        state.update((list(recent),))
        yield batch.assign(admitted=decisions)[["client", "request_id", "t", "admitted"]]

    client = F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN)).alias("client")
    timed = requests.select(client, "request_id", F.unix_micros("ts").alias("t"))
    decided = timed.groupBy("client").applyInPandasWithState(
        decide,
        outputStructType=f"client string, request_id {id_type}, t bigint, admitted boolean",
        stateStructType="recent array<bigint>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return decided.withColumn("client", F.col("client").try_cast(client_type))
