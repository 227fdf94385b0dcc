"""State machines over events that arrive out of order.

Events wait in state until the watermark has passed them; then they are folded in order of time and id.
So a result doesn't depend on how events are dealt over batches, as long as none is later than the
watermark's delay (Spark counts those that are).

Keys are dealt over shards by hash, and a shard is what Spark keeps state and timers for: each call to
the state store goes through a socket, so one for each key would cost more than the events themselves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.staging import shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = "spark.sql.shuffle.partitions"
#: Groups of keys that share one state; a stream that goes on from a checkpoint must keep its number.
SHARDS = 1024


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


class Ordered(StatefulProcessor):
    """Folds each key's events in order. A subclass gives ``start``, the state of a new key; ``fold``, which takes
    an event into it; ``columns`` of an event beside ``at_us`` and ``event_id``; ``emit``, the rows (as columns)
    that are due at a watermark; and ``wakes``, the time at which it wants to be asked again, or None."""

    columns: list[str] = []

    def start(self) -> dict:
        raise NotImplementedError

    def fold(self, state: dict, at_us: int, event: dict) -> None:
        raise NotImplementedError

    def emit(self, key: tuple, state: dict, watermark_ms: int) -> dict[str, list]:
        raise NotImplementedError

    def wakes(self, state: dict) -> int | None:
        return None

    def bound(self, keys: list[str], events: pa.Schema) -> Ordered:
        """This processor for events with the given columns."""
        self.keys, self.events = keys, events
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.held = handle.getValueState("held", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pa.Table.from_pandas(part[self.events.names], schema=self.events, preserve_index=False) for part in rows]
        new = pa.concat_tables(parts)
        if new.num_rows:
            self.waiting.appendValue((_packed(new),))
            self.handle.registerTimer(pa.compute.min(new["at_us"]).as_py() // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = pa.concat_tables([self.events.empty_table(), *(_unpacked(w[0]) for w in self.waiting.get())] if self.waiting.exists() else [self.events.empty_table()])
        passed = pa.compute.less(waiting["at_us"], watermark * 1000)
        ready, rest = waiting.filter(passed), waiting.filter(pa.compute.invert(passed))
        states: dict[tuple, dict] = {}
        if self.held.exists():
            held = _unpacked(self.held.get()[0])
            states = {k: json.loads(s) for *k, s in zip(*(held[c].to_pylist() for c in [*self.keys, "state"])) for k in [tuple(k)]}
        due = {k: None for k, s in states.items() if (wake := self.wakes(s)) is not None and wake <= watermark}
        ordered = ready.sort_by([("at_us", "ascending"), ("event_id", "ascending")])
        values = [ordered[c].to_pylist() for c in self.columns]
        for one, at_us, *event in zip(zip(*(ordered[k].to_pylist() for k in self.keys)), ordered["at_us"].to_pylist(), *values):
            if one not in states:
                states[one] = self.start()
            self.fold(states[one], at_us, dict(zip(self.columns, event)))
            due[one] = None
        out: dict[str, list] = {}
        for one in due:
            for name, column in self.emit(one, states[one], watermark).items():
                out.setdefault(name, []).extend(column)
        if ready.num_rows:
            self.waiting.clear()
            if rest.num_rows:
                self.waiting.appendValue((_packed(rest),))
        if due:
            typed = pa.schema([*(self.events.field(k) for k in self.keys), pa.field("state", pa.string())])
            columns = [*zip(*states), [json.dumps(s, default=int) for s in states.values()]]
            self.held.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, typed)], schema=typed)),))
        times = [w for w in map(self.wakes, states.values()) if w is not None and w > watermark]
        if rest.num_rows:
            times.append(pa.compute.min(rest["at_us"]).as_py() // 1000 + 1)
        if times:
            self.handle.registerTimer(min(times))
        frame = pd.DataFrame(out)
        return iter([frame] if len(frame) else [])


def folded(stream: DataFrame, keys: list[str], processor: Ordered, schema: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """What ``processor`` emits for each of ``keys``. ``stream``: keys, ts (a timestamp), at_us (the same in whole
    microseconds), event_id, and the processor's columns."""
    timed = stream.withWatermark("ts", delay).withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    events = to_arrow_schema(stream.select(*keys, "at_us", "event_id", *processor.columns).schema)
    return timed.groupBy("shard").transformWithStateInPandas(processor.bound(keys, events), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_to_table(spark: SparkSession, rows: DataFrame, name: str, path: str = "") -> DataFrame:
    """Run a stateful stream until its source has nothing more; what it has emitted. ``path`` goes on where an
    earlier run stopped. The state store is set for this query only, as is the number of its parts: each has a
    store of its own to open and to save in every batch, so there are no more than cores. Shards bound what a
    part holds at one time."""
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    parts = min(int(spark.conf.get(PARTS)), spark.sparkContext.defaultParallelism)
    settings = {STORE: ROCKSDB, PARTS: str(parts)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(f"{path}/out")
