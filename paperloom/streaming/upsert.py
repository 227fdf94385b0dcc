"""A sink that keeps what an operator derives for each key, from a log that may be replayed.

A batch is written under its number, in place of what an earlier try of it has left, and only the keys
that it touches are derived anew from their part of the log. Readers take each key's last version and
each event once, so neither a batch that runs twice nor an event that is sent twice changes anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.staging import shared_dir

#: Buckets of keys that the log is laid out by: a batch reads the buckets of the keys it touches.
BUCKETS = 64


@dataclass
class LogSink:
    """``derive(events)`` gives rows with ``keys`` from all events of these keys; ``event_id`` tells events
    apart, and ``columns`` is the schema of an event. Folders are in the shared one."""

    spark: SparkSession
    keys: list[str]
    event_id: list[str]
    derive: Callable[[DataFrame], DataFrame]
    path: str = ""

    def __post_init__(self):
        self.path = self.path or f"{shared_dir(self.spark)}/sink-{uuid.uuid4().hex}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, part: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}"))

    def events(self) -> DataFrame:
        """Every event of the log once; of events with one id, that of the earliest batch."""
        log = self.spark.read.parquet(f"{self.path}/log")
        rest = [c for c in log.columns if c not in (*self.event_id, "batch", "bucket")]
        first = log.groupBy(*self.event_id).agg(F.min_by(F.struct("bucket", *rest), "batch").alias("e"))
        return first.select(*self.event_id, "e.*")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; for ``foreachBatch``."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={number}")
        written = self.spark.read.parquet(f"{self.path}/log/batch={number}")
        touched = written.select(*self.keys).distinct()
        buckets = [r[0] for r in written.select("bucket").distinct().collect()]  # at most BUCKETS
        own = self.events().filter(F.col("bucket").isin(buckets)).drop("bucket").join(touched, self.keys, "left_semi")
        derived = self.derive(own)
        # A key that is gone leaves a row that says so.
        state = touched.join(derived.withColumn("held", F.lit(True)), self.keys, "left").withColumn("held", F.coalesce("held", F.lit(False)))
        state.write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")

    def state(self) -> DataFrame | None:
        """The last version of every key that is there; None before the first batch."""
        if not self._exists("state"):
            return None
        versions = self.spark.read.parquet(f"{self.path}/state")
        rest = [c for c in versions.columns if c not in (*self.keys, "batch")]
        last = versions.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
        return last.select(*self.keys, "s.*").filter("held").drop("held")


def run_available(stream: DataFrame, sink: LogSink) -> None:
    """Run a stream through a sink until its source has nothing more."""
    writer = stream.writeStream.foreachBatch(sink.apply).option("checkpointLocation", f"{sink.path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
