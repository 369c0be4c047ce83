"""The stateful tracker over shuffled, repeated and restarted micro-batches against the batch operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.operators import quota
from folioflow.streaming import tracker

pytest.importorskip("google.protobuf")  # the state server of the engine speaks it
EVENTS = "device bigint, seq bigint, ts timestamp, now timestamp, op string, success boolean"
START = datetime(2024, 3, 1, 20)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(tracker.PROVIDER)
    spark.conf.set(tracker.PROVIDER, tracker.ROCKS)
    yield spark
    spark.conf.set(tracker.PROVIDER, before)


def operations(n=240):
    rng = random.Random(6)
    out = []
    for seq in range(n):
        ts = START + timedelta(minutes=4 * seq)
        now = ts - timedelta(days=2) if rng.random() < 0.08 else ts - timedelta(minutes=rng.choice([0, 0, 5])) + timedelta(hours=30 if rng.random() < 0.01 else 0)
        out.append((rng.randrange(4), seq, ts, now, rng.choice(["ocr", "pdf", "export", "other", None]), rng.random() < 0.8))
    return out


def fed(spark, folder, batches, run):
    """Each batch is a file and each start of the query a restart from the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = run(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def shuffled(rows, parts=3):
    """Batches in the order of time, each out of order inside and with rows of the one before again; then one that closes the day."""
    rng, size = random.Random(2), len(rows) // parts
    batches = [rows[k * size : (k + 1) * size] for k in range(parts)]
    for k, b in enumerate(batches):
        b += rng.sample(batches[k - 1] if k else b, 9)
        rng.shuffle(b)
    return [*batches, [(99, 10**6, START + timedelta(days=30), START + timedelta(days=30), "ocr", True)]]


def test_usage_over_restarts_equals_the_finished_log(rocks, tmp_path):
    rows = operations()
    log = rocks.createDataFrame(rows, EVENTS)
    batch = quota.admitted(log.withColumn("op", F.coalesce("op", F.lit(""))))
    want = {(r.device, r.seq): (r.rollback, str(r.day), r.used, r.admitted) for r in batch.collect()}
    found = fed(rocks, tmp_path, shuffled(rows), tracker.track_usage)
    got = {(r.device, r.seq): (r.rollback, r.day, r.used, r.admitted) for r in found if r.device != 99}
    assert len(got) == len([r for r in found if r.device != 99]) == len(rows)
    assert got == want


def test_cap_over_restarts_equals_the_finished_log(rocks, tmp_path):
    rows = operations(160)
    log = rocks.createDataFrame(rows, EVENTS)
    want = {(r.user, r.seq): r.shown for r in quota.interstitials(log.select(F.col("device").alias("user"), "seq", F.unix_micros("now").cast("double").alias("at")).withColumn("at", F.col("at") / 1e6)).collect()}
    run = lambda s: tracker.cap_interstitials(s.withColumnsRenamed({"device": "user", "now": "at"}))
    got = {(r.user, r.seq): r.shown for r in fed(rocks, tmp_path, shuffled(rows, 2), run) if r.user != 99}
    assert got == want and any(want.values())


def test_usage_goes_on_from_a_stored_record_and_ends(rocks, tmp_path):
    day = datetime(2024, 3, 1)
    stored = rocks.createDataFrame([(1, "2024-03-01", 9, 0, 0, day + timedelta(hours=9))], "device bigint, day string, ocr bigint, pdf bigint, export bigint, seen timestamp")
    at = lambda h, d=0: day + timedelta(hours=h, days=d)
    first = [(1, 1, at(10), at(10), "ocr", True), (1, 2, at(11), at(8), "ocr", True), (2, 1, at(10), at(10), "ocr", True)]
    later = [(3, 1, at(0, 9), at(0, 9), "ocr", True)]
    again = [(1, 3, at(1, 9), at(11), "ocr", True), (3, 2, at(0, 40), at(0, 40), "ocr", True)]
    found = fed(rocks, tmp_path, [first, later, again], lambda s: tracker.track_usage(s, ttl_s=3 * 86400, stored=stored))
    got = {(r.device, r.seq): (r.rollback, r.day, r.used, r.admitted) for r in found}
    assert got[(1, 1)] == (False, "2024-03-01", 10, True) and got[(1, 2)] == (True, "2024-03-01", 11, False)
    assert got[(2, 1)] == (False, "2024-03-01", 1, True)
    # nine days later the state of device 1 is gone: its clock may run back and its counters start again
    assert got[(1, 3)] == (False, "2024-03-01", 1, True)


def test_state_store_is_asked_for(spark):
    before = spark.conf.get(tracker.PROVIDER)
    spark.conf.unset(tracker.PROVIDER)
    try:
        with pytest.raises(RuntimeError, match="stateStore"):
            tracker.track_usage(spark.createDataFrame([], EVENTS))
    finally:
        spark.conf.set(tracker.PROVIDER, before)


class Kept:
    """A value or map state in memory that counts how often it is read by key."""

    def __init__(self):
        self.held, self.read = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def getValue(self, key):
        self.read += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self):
        self.held.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(self.timers), self.timers.discard, self.timers.add

    def state(self, name, *_):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState = state


class Mark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: int(at.timestamp() * 1000)


def frames(rows, size):
    table = pd.DataFrame(rows, columns=["device", "seq", "ts", "now", "op", "success"])
    table["now"] = pd.to_datetime(table["now"])
    return (table.iloc[k : k + size] for k in range(0, len(table), size))


def test_waiting_operations_are_added_unread_and_let_go_in_parts(monkeypatch):
    monkeypatch.setattr(tracker, "ROWS", 16)
    rows = [(1, seq, ts, now, op, ok) for _, seq, ts, now, op, ok in operations(200)]
    one = tracker.UsageTracker(None)
    one.init(handle := Handle())
    waiting, rng = handle.states["waiting"], random.Random(5)
    twice = rng.sample(rows * 2, 400)
    for part in (twice[:250], twice[250:]):
        assert not list(one.handleInputRows((1,), frames(part, 50), None))
    assert waiting.read == 0 and len(waiting.held) == 8 and len(handle.timers) == 1
    out = []
    for at in (rows[90][2], rows[150][2], rows[-1][2]):
        parts = list(one.handleExpiredTimer((1,), Mark(at.replace(tzinfo=timezone.utc)), None))
        assert parts and all(len(p) <= 16 for p in parts)
        out += parts
        assert len(handle.timers) == (at != rows[-1][2])
    got = pd.concat(out)
    assert got["seq"].tolist() == list(range(200)) and not waiting.held
    whole = tracker.UsageTracker(None)
    whole.init(Handle())
    assert not list(whole.handleInputRows((1,), frames(rows, 200), None))
    assert pd.concat(whole.handleExpiredTimer((1,), Mark(datetime(2100, 1, 1)), None)).values.tolist() == got.values.tolist()


def test_a_clock_that_is_null_moves_nothing():
    day = datetime(2024, 3, 1, 12)
    rows = [(1, k, day + timedelta(minutes=k), None if k in (0, 2) else day + timedelta(minutes=k), "ocr", True) for k in range(4)]
    one = tracker.UsageTracker(None)
    one.init(Handle())
    assert not list(one.handleInputRows((1,), frames(rows, 4), None))
    got = pd.concat(one.handleExpiredTimer((1,), Mark(datetime(2100, 1, 1)), None))
    assert got[["rollback", "day", "used"]].values.tolist() == [[False, "", 1], [False, "2024-03-01", 1], [False, "2024-03-01", 2], [False, "2024-03-01", 3]]
