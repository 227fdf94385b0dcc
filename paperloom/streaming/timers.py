"""Study timers: the state machine of a learner's day, one active task at most."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..operators.plans import SETTLES, STARTS
from .ordered import Ordered, folded

_SCHEMA = "learner_id bigint, plan_date date, task_id bigint, as_of timestamp, actual_seconds bigint, status string"


class PlanTimer(Ordered):
    """State: whether the plan is paused, the active task and since when, and each task's seconds and status.
    A learner's day has few tasks, so one state stays small."""

    columns = ["task_id", "action"]

    def start(self) -> dict:
        return {"paused": False, "active": None, "since": 0, "tasks": {}, "touched": []}

    def _settle(self, state: dict, at_us: int, status: str) -> None:
        task = state["tasks"][str(state["active"])]
        task["seconds"] += max(0, at_us - state["since"]) // 1_000_000
        task["status"] = status
        state["touched"].append(str(state["active"]))
        state["active"] = None

    def fold(self, state: dict, at_us: int, event: dict) -> None:
        action, task = event["action"], event["task_id"]
        if action in ("plan_pause", "plan_resume"):
            state["paused"] = action == "plan_pause"
            if state["paused"] and state["active"] is not None:
                self._settle(state, at_us, "paused")
            return
        if action not in STARTS and action not in SETTLES or (action in STARTS and state["paused"]):
            return
        own = state["tasks"].setdefault(str(task), {"seconds": 0, "status": "pending"})
        state["touched"].append(str(task))
        if action in SETTLES:
            if state["active"] == task:
                self._settle(state, at_us, SETTLES[action])
            own["status"] = SETTLES[action]
        elif state["active"] != task:
            if state["active"] is not None:
                self._settle(state, at_us, "paused")
            state.update(active=task, since=at_us)
            own["status"] = "active"

    def emit(self, key: tuple, state: dict, watermark_ms: int) -> dict[str, list]:
        touched = sorted(set(state["touched"]))
        state["touched"] = []
        n, at = len(touched), dt.datetime.fromtimestamp(watermark_ms / 1000, dt.timezone.utc)
        return {
            "learner_id": [int(key[0])] * n, "plan_date": [key[1]] * n, "task_id": [int(t) for t in touched], "as_of": [at] * n,
            "actual_seconds": [state["tasks"][t]["seconds"] for t in touched], "status": [state["tasks"][t]["status"] for t in touched],
        }


def timer_stream(actions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``learner_id, plan_date, task_id, as_of, actual_seconds, status``: a task's state each time that the watermark
    passes actions on it. Seconds are those of activities that have ended. ``actions``: learner_id, plan_date,
    event_id, ts, task_id, action; order is by ``ts``, then ``event_id``."""
    timed = actions.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at_us", F.unix_micros("ts"))
    return folded(timed.select("learner_id", "plan_date", "ts", "at_us", "event_id", "task_id", "action"), ["learner_id", "plan_date"], PlanTimer(), _SCHEMA, delay)


def latest_times(emitted: DataFrame) -> DataFrame:
    """Each task's last state."""
    last = emitted.groupBy("learner_id", "plan_date", "task_id").agg(F.max_by(F.struct("actual_seconds", "status"), "as_of").alias("s"))
    return last.select("learner_id", "plan_date", "task_id", "s.actual_seconds", "s.status")
