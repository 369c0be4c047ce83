"""The usage tracker over a stream of operations, with state per device.

An extension: the batch operators in operators.quota say the same over a finished log. State is
the latest clock, the effective day and a counter of each kind of operation on it (kinds without a daily limit
too), whatever the length of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quota import TOLERANCE_S
from ..operators.shipping import shipped

OUTPUT = "device bigint, seq bigint, rollback boolean, day string, used bigint"
STATE = "latest timestamp, day string, used string"


def _track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    latest, day, counts = state.get if state.exists else (None, "", "{}")
    used = json.loads(counts)
    slack = pd.Timedelta(seconds=TOLERANCE_S)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for r in rows.itertuples():
        behind = latest is not None and r.now + slack < latest
        if not behind:
            latest = r.now if latest is None else max(latest, r.now)
            today = r.now.strftime("%Y-%m-%d")
            if today > day:
                day, used = today, {}
        op = r.op or ""
        if r.success:
            used[op] = used.get(op, 0) + 1
        out.append((key[0], r.seq, behind, day, used.get(op, 0)))
    state.update((latest, day, json.dumps(used)))
    yield pd.DataFrame(out, columns=["device", "seq", "rollback", "day", "used"])


def track(events: DataFrame) -> DataFrame:
    """events (device, seq, now, op, success), arriving in the order of seq per device."""
    return shipped(events).groupBy("device").applyInPandasWithState(_track, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(events: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a streaming input to its present end and return what came out."""
    query = track(events).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return events.sparkSession.table(name)
