"""Retention: what is in the trash goes when its time is over, unless it was restored before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..operators.trash import RETENTION_DAYS
from .ordered import Ordered, folded

_SCHEMA = "item_id string, purged_at timestamp"
_KEPT_US = RETENTION_DAYS * 86_400_000_000


class Retention(Ordered):
    """State: when the item goes, and whether it is gone. Its timer is set when it comes into the trash and
    deleted when it is restored in time; what comes later than its deadline changes nothing."""

    columns = ["kind"]

    def start(self) -> dict:
        return {"until": None, "gone": False}

    def fold(self, state: dict, at_us: int, event: dict) -> None:
        until = state["until"]
        if event["kind"] == "trash" and until is None:
            state["until"] = at_us + _KEPT_US
        elif event["kind"] == "restore" and until is not None and at_us < until:
            state["until"] = None

    def wakes(self, state: dict) -> int | None:
        return None if state["gone"] or state["until"] is None else state["until"] // 1000 + 1

    def emit(self, key: tuple, state: dict, watermark_ms: int) -> dict[str, list]:
        if state["gone"] or state["until"] is None or state["until"] // 1000 >= watermark_ms:
            return {"item_id": [], "purged_at": []}
        state["gone"] = True
        at = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=state["until"])
        return {"item_id": [key[0]], "purged_at": [at]}


def retention_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``item_id, purged_at`` of every item whose time is over, once. ``events``: item_id, event_id, ts, kind ('trash'
    or 'restore'); order is by ``ts``, then ``event_id``. An item that is in the trash already keeps its deadline."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at_us", F.unix_micros("ts"))
    return folded(timed.select("item_id", "ts", "at_us", "event_id", "kind"), ["item_id"], Retention(), _SCHEMA, delay)
