"""Timers over batches that come out of order, against the batch operators and a plain fold."""

import datetime as dt
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.operators import plans as pl
from paperloom.streaming import latest_times, retention_stream, run_to_table, timer_stream
from paperloom.streaming.retention import Retention
from paperloom.streaming.timers import PlanTimer

DAY = dt.datetime(2024, 1, 1)


def dealt(spark, events, schema, folder, seed):
    """Events in files, each up to half an hour before or after the ones next to it, and a last one far off."""
    rng = random.Random(seed)
    at = schema.split(", ").index("ts timestamp_ntz")
    order = sorted(events, key=lambda e: e[at] + dt.timedelta(minutes=rng.randrange(30)))
    size = len(order) // 5 + 1
    for n in range(5):
        spark.createDataFrame(order[n * size:(n + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


class Store:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, [], []

    def getListState(self, name, schema):
        return self._part()

    getValueState = getListState

    def _part(self):
        part = Store()
        part.owner = self
        return part

    def _count(self):
        self.owner.calls += 1

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def exists(self):
        self._count()
        return bool(self.values)

    def get(self):
        self._count()
        return list(self.values) if isinstance(self.values, list) else self.values

    def appendValue(self, value):
        self._count()
        self.values.append(value)

    def clear(self):
        self._count()
        self.values = []

    def update(self, value):
        self._count()
        self.values = value


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def fed(processor, keys, schema, events, watermarks):
    """Calls to the store and rows of all watermarks, for events of one shard."""
    store = Store()
    processor.bound(keys, schema).init(store)
    list(processor.handleInputRows((0,), iter([events]), Clock(0)))
    rows = [frame for at in watermarks for frame in processor.handleExpiredTimer((0,), Clock(at), None)]
    return store.calls, pd.concat(rows)


def test_calls_to_the_store_dont_grow_with_the_days_of_learners():
    schema = pa.schema([("learner_id", pa.int64()), ("plan_date", pa.date32()), ("at_us", pa.int64()), ("event_id", pa.int64()), ("task_id", pa.int64()), ("action", pa.string())])
    n = 500
    events = pd.DataFrame({"learner_id": range(n), "plan_date": [DAY.date()] * n, "at_us": [i * 1_000_000 for i in range(n)], "event_id": range(n), "task_id": [1] * n, "action": ["start"] * n})
    calls, rows = fed(PlanTimer(), ["learner_id", "plan_date"], schema, events, [n * 500, n * 2000])
    assert len(rows) == n and set(rows["status"]) == {"active"}
    assert calls < 30


def test_calls_to_the_store_dont_grow_with_the_items():
    schema = pa.schema([("item_id", pa.string()), ("at_us", pa.int64()), ("event_id", pa.int64()), ("kind", pa.string())])
    n, day = 500, 86_400_000
    events = pd.DataFrame({"item_id": [f"i{i}" for i in range(n)] * 2, "at_us": [0] * n + [day * 1000] * n, "event_id": range(2 * n), "kind": ["trash"] * n + ["restore"] * (n // 2) + ["trash"] * (n // 2)})
    calls, rows = fed(Retention(), ["item_id"], schema, events, [2 * day, 14 * day, 16 * day, 17 * day])
    assert sorted(rows["item_id"]) == sorted(f"i{i}" for i in range(n // 2, n))
    assert calls < 40


def test_timers_agree_with_the_batch(spark, tmp_path):
    rng = random.Random(5)
    kinds = [*pl.STARTS, *pl.STARTS, *pl.SETTLES, *pl.PLAN_ACTIONS, "odd"]
    schema = "event_id long, ts timestamp_ntz, learner_id long, plan_date date, task_id long, action string"
    events = [(i, DAY + dt.timedelta(seconds=rng.randrange(36_000), microseconds=rng.randrange(10**6)), rng.randrange(3), DAY.date(), rng.randrange(3), rng.choice(kinds)) for i in range(150)]
    last = (999, DAY + dt.timedelta(days=2), 9, DAY.date(), 0, "odd")
    stream = dealt(spark, [*events, last], schema, tmp_path / "in", 1)
    emitted = run_to_table(spark, timer_stream(stream), "timers", str(tmp_path / "out"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in latest_times(emitted).collect()}
    whole = spark.createDataFrame(events, schema)
    status = {tuple(r)[:3]: r.status for r in pl.task_status(whole).collect()}
    assert {k: v[1] for k, v in got.items()} == status
    # The batch counts what is open up to a time; up to the start of the log that is nothing.
    spent = {tuple(r)[:3]: r.actual_seconds for r in pl.task_times(whole, str(DAY)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: spent.get(k, 0) for k in got}
    assert emitted.select("as_of").distinct().count() > 1


def kept(events, until):
    """Items purged by ``until``, one event after the other."""
    deadline, purged = {}, {}
    for _, ts, item, kind in sorted(events, key=lambda e: (e[1], e[0])):
        if item in deadline and deadline[item] <= ts:
            continue
        if kind == "trash":
            deadline.setdefault(item, ts + dt.timedelta(days=15))
        else:
            deadline.pop(item, None)
    return {i: d for i, d in deadline.items() if d < until}


def test_restored_items_stay_and_others_go_once(spark, tmp_path):
    rng = random.Random(6)
    schema = "event_id long, ts timestamp_ntz, item_id string, kind string"
    events = [(i, DAY + dt.timedelta(hours=rng.randrange(24 * 60), seconds=rng.randrange(3600)), f"p{rng.randrange(25)}", rng.choice(["trash", "trash", "restore"])) for i in range(120)]
    last = (999, DAY + dt.timedelta(days=70), "end", "restore")
    stream = dealt(spark, [*events, last], schema, tmp_path / "in", 2)
    out = run_to_table(spark, retention_stream(stream), "retention", str(tmp_path / "out"))
    rows = [(r.item_id, r.at) for r in out.select("item_id", F.col("purged_at").cast("timestamp_ntz").alias("at")).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == kept(events, last[1] - dt.timedelta(hours=1))
    # A second run finds nothing new and purges nothing again; a later event lets the rest go.
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert run_to_table(spark, retention_stream(again), "retention", str(tmp_path / "out")).count() == len(rows)
    spark.createDataFrame([(1000, DAY + dt.timedelta(days=200), "end", "restore")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = [(r.item_id, r.at) for r in run_to_table(spark, retention_stream(again), "retention", str(tmp_path / "out")).select("item_id", F.col("purged_at").cast("timestamp_ntz").alias("at")).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == kept(events, DAY + dt.timedelta(days=199))


def test_a_stream_has_no_more_parts_of_state_than_cores(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, item_id string, kind string"
    events = [(i, DAY + dt.timedelta(days=i), f"p{i % 5}", "trash") for i in range(30)]
    stream = dealt(spark, events, schema, tmp_path / "in", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        run_to_table(spark, retention_stream(stream), "retention", str(tmp_path / "out"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept_in = [p for p in (tmp_path / "out" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(kept_in) <= spark.sparkContext.defaultParallelism
