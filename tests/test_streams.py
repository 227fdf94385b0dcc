"""A sink's state after batches that repeat, overlap and come out of order."""

import datetime as dt
import random

from paperloom.operators import ledger as lg
from paperloom.streaming import LogSink

SCHEMA = "event_id long, ts timestamp_ntz, entry_id string, kind string, is_correct boolean, patch_status string"


def test_replayed_and_repeated_batches_change_nothing(spark):
    rng = random.Random(2)
    kinds = ["graded_wrong", "attempt", "mark_reviewed", "patch", "note", "delete"]
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400)), f"e{rng.randrange(9)}", rng.choice(kinds), rng.choice([True, False]), rng.choice(lg.STATUSES)) for i in range(120)]
    whole = spark.createDataFrame(events, SCHEMA)
    sink = LogSink(spark, ["entry_id"], ["event_id"], lg.ledger_status)
    assert sink.state() is None
    parts = [events[:50], events[40:90], events[90:]]  # ten events come twice
    for number, part in enumerate(parts):
        sink.apply(spark.createDataFrame(part, SCHEMA), number)
        if number == 1:
            sink.apply(spark.createDataFrame(part, SCHEMA), number)  # tried again
    want = sorted(tuple(r) for r in lg.ledger_status(whole).collect())
    assert sorted(tuple(r) for r in sink.state().collect()) == want
    sink.apply(spark.createDataFrame(parts[0], SCHEMA), 3)
    assert sorted(tuple(r) for r in sink.state().collect()) == want and sink.events().count() == len(events)
