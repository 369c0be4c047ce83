"""The usage tracker and the interstitial cap as state over a stream that may be late, out of order, replayed or restarted.

The batch operators in operators.quota say what comes out of a finished log; here it comes out while the log is still growing. What the
rules ask for is a device's (or user's) operations in the order of `seq`, so an operation waits in state until the watermark of its
`ts`, the time of the service, has passed: by then every operation that still counts has come. A timer at the earliest waiting time
lets the waiting ones go, in order, through a fold whose state is a few numbers, whatever the length of the stream. An operation that
was seen before (a source that delivers twice) is dropped by its seq when it is let go and, since those behind it have been released in
order, ever after. Timers and state are restored with the checkpoint, so a restart goes on where it stopped.

Waiting operations lie packed, as the Arrow batches they came in, each under a number of its own: more are added without reading those
that wait, and no message holds more than one batch. When a timer fires, a device's waiting operations are in its task's memory, some
30 bytes each.

A device's state starts from its stored usage record, if one is given; it is cleared when the device has been silent for `ttl_s` of
event time, which ends what an idle device costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import APART_S, DAILY, EVERY, TOLERANCE_S
from ..operators.shipping import shipped

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = pa.schema({"seq": pa.int64(), "ts": pa.int64(), "now": pa.int64(), "op": pa.string(), "success": pa.bool_()})
#: Operations of a batch that is kept or put out.
ROWS = 100_000
#: What a time that is null is in microseconds.
NEVER = np.iinfo(np.int64).min
DAY_US = 86_400_000_000
USAGE = "device bigint, seq bigint, rollback boolean, day string, used bigint, admitted boolean"
CAPPED = "user bigint, seq bigint, shown boolean"


def _us(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _batch(frame: pd.DataFrame) -> pa.RecordBatch:
    columns = [frame["seq"], _us(frame["ts"]), _us(frame["now"]), frame["op"], frame["success"]]
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, WAITING.types, strict=True)], schema=WAITING)


class _InOrder(StatefulProcessor):
    """Holds operations back until the watermark has passed them; subclasses fold them in the order of seq."""

    def __init__(self, ttl_s: int | None) -> None:
        self.ttl_us = None if ttl_s is None else ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "part bigint", "rows binary")
        self.parts = handle.getValueState("parts", "n bigint")
        self.done = handle.getValueState("done", "seq bigint, ts_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.done.get()[0] if self.done.exists() else None
        before = parts = self._parts()
        first = None
        for frame in rows:
            new = frame if last is None else frame[frame["seq"] > last]
            if len(new):
                batch = _batch(new)
                self._keep(parts, batch)
                parts += 1
                least = int(batch["ts"].to_numpy().min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.parts.update((parts,))
            self._wake(first // 1000 + 1, sooner=before > 0)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        late = held["ts"].to_numpy() > mark
        due, rest = held.filter(pa.array(~late)), held.filter(pa.array(late))
        del held
        if len(due):
            self.done.update((due["seq"][-1].as_py(), int(due["ts"].to_numpy().max())))
            out = self.fold(key[0], due)
            for at in range(0, len(out), ROWS):
                yield out.iloc[at : at + ROWS]
        if len(rest):
            if len(due):
                self.waiting.clear()
                batches = rest.combine_chunks().to_batches(ROWS)
                for k, batch in enumerate(batches):
                    self._keep(k, batch)
                self.parts.update((len(batches),))
            self._wake(int(rest["ts"].to_numpy().min()) // 1000 + 1)
        elif self.ttl_us is not None and self.done.exists() and self.done.get()[1] + self.ttl_us <= mark:
            self._wake(None)
            self.forget()
        else:
            self._empty()
            self._wake((self.done.get()[1] + self.ttl_us) // 1000 + 1 if self.ttl_us is not None and self.done.exists() else None)

    def _parts(self) -> int:
        return self.parts.get()[0] if self.parts.exists() else 0

    def _keep(self, part: int, batch: pa.RecordBatch) -> None:
        self.waiting.updateValue((part,), (batch.serialize().to_pybytes(),))

    def _held(self) -> pa.Table:
        """All that waits in the order of seq; of what came twice, what came first."""
        packed = (self.waiting.getValue((k,))[0] for k in range(self._parts()))
        held = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(p)), WAITING) for p in packed], WAITING)
        seq = held["seq"].to_numpy()
        order = np.argsort(seq, kind="stable")
        seq = seq[order]
        return held.take(order[np.append(True, seq[1:] != seq[:-1])[: len(seq)]])

    def _wake(self, at: int | None, sooner: bool = False) -> None:
        """One timer at most, at a time in milliseconds; if it is only to be sooner, an earlier one stays."""
        timers = list(self.handle.listTimers())
        if sooner and timers and min(timers) <= at:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def _empty(self) -> None:
        self.waiting.clear()
        self.parts.clear()

    def forget(self) -> None:
        self._empty()
        self.done.clear()

    def fold(self, key, rows: pa.Table) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class UsageTracker(_InOrder):
    """The daily counters of a device: the latest clock, the effective day, and what each kind of operation has used on it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", "latest_us bigint, day string")
        self.used = handle.getMapState("used", "op string", "n bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A stored usage record: day, counters and, as seen, the latest clock."""
        r = initialState.iloc[0]
        self.clock.update((None if pd.isna(r["seen"]) else int(_us(initialState["seen"])[0]), r["day"] or ""))
        for op in DAILY:
            self.used.updateValue((op,), (int(r[op]),))

    def fold(self, key, rows: pa.Table) -> pd.DataFrame:
        latest, day = self.clock.get() if self.clock.exists() else (None, "")
        used = {k[0]: v[0] for k, v in self.used.iterator()}
        now, success = rows["now"].to_numpy(), rows["success"].fill_null(False).to_numpy()
        # an operation on a clock that ran back can never be the latest seen, so the plain maximum is right; null clocks are no clocks
        seen = np.maximum.accumulate(np.append(NEVER if latest is None else latest, now))
        behind = (now != NEVER) & (seen[:-1] != NEVER) & (now < seen[:-1] - TOLERANCE_S * 1_000_000)
        number = np.maximum.accumulate(np.where(behind | (now == NEVER), NEVER, now // DAY_US))
        numbers, at = np.unique(number, return_inverse=True)
        # a stored day holds until a later one; days that it covers are one with it
        days = [day if d == NEVER else max(day, str(np.datetime64(int(d), "D"))) for d in numbers]
        names, place = np.unique(days, return_inverse=True)
        names, on = names.tolist(), place[at]
        ops, op = np.unique(rows["op"].fill_null("").to_numpy().astype(object), return_inverse=True)
        first = np.array([[used.get(o, 0) if d == day else 0 for o in ops] for d in names])[on, op]
        count = first + pd.Series(success.astype("int64")).groupby(on * len(ops) + op).cumsum().to_numpy()
        limit = np.array([DAILY.get(o, np.iinfo(np.int64).max) for o in ops])[op]
        out = pd.DataFrame({"device": key, "seq": rows["seq"].to_numpy(), "rollback": behind, "day": np.array(names, object)[on], "used": count, "admitted": count - success < limit})
        last = on == on[-1]
        used = (used if names[on[-1]] == day else {}) | dict(zip(ops[op[last]].tolist(), count[last].tolist(), strict=True))
        self.clock.update((None if seen[-1] == NEVER else int(seen[-1]), names[on[-1]]))
        self.used.clear()
        for name, n in used.items():
            self.used.updateValue((name,), (n,))
        return out

    def forget(self) -> None:
        super().forget()
        self.clock.clear()
        self.used.clear()


class InterstitialCap(_InOrder):
    """The cap of a user: completed operations since the last interstitial, and when that was."""

    def __init__(self, ttl_s: int | None, every: int, apart_s: int) -> None:
        super().__init__(ttl_s)
        self.every, self.apart_us = every, apart_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.cap = handle.getValueState("cap", "count bigint, last_us bigint")

    def fold(self, key, rows: pa.Table) -> pd.DataFrame:
        count, last = self.cap.get() if self.cap.exists() else (0, None)
        out = []
        for at in rows["now"].to_pylist():
            count += 1
            shown = count >= self.every and (last is None or at - last >= self.apart_us)
            if shown:
                count, last = 0, at
            out.append(shown)
        self.cap.update((count, last))
        return pd.DataFrame({"user": key, "seq": rows["seq"].to_numpy(), "shown": out})

    def forget(self) -> None:
        super().forget()
        self.cap.clear()


def _needs_rocks(df: DataFrame) -> None:
    if df.sparkSession.conf.get(PROVIDER) != ROCKS:
        raise RuntimeError(f"set {PROVIDER} to {ROCKS} before the stream is defined")


def track_usage(events: DataFrame, late: str = "10 minutes", ttl_s: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """events (device, seq, ts, now, op, success) in any order, each as late as `late` behind the latest ts, give what
    quota.tracked() and quota.admitted() give for the finished log. stored: (device, day, ocr, pdf, export, seen), one row a device."""
    _needs_rocks(events)
    rows = shipped(events).select("device", "seq", "ts", "now", "op", "success").withWatermark("ts", late).groupBy("device")
    first = None if stored is None else stored.select("device", "day", *DAILY, "seen").groupBy("device")
    return rows.transformWithStateInPandas(UsageTracker(ttl_s), USAGE, "Append", "EventTime", first)


def cap_interstitials(calls: DataFrame, late: str = "10 minutes", ttl_s: int | None = None, every: int = EVERY, apart_s: int = APART_S) -> DataFrame:
    """calls (user, seq, ts, at), at being the device's clock as a timestamp: what quota.interstitials() gives for the finished log."""
    _needs_rocks(calls)
    rows = shipped(calls).select("user", "seq", "ts", F.col("at").alias("now"), F.lit("").alias("op"), F.lit(True).alias("success"))
    return rows.withWatermark("ts", late).groupBy("user").transformWithStateInPandas(InterstitialCap(ttl_s, every, apart_s), CAPPED, "Append", "EventTime")
