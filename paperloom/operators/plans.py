"""Study plans: how long a learner worked on each task of a day, from the log of actions.

A plan has one active task at most. What ends an activity is looked up instead of folded: the next
action that settles the task, the next accepted start of another task, or the next pause of the plan,
whichever comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scans import Running, running
from ..functions.staging import staged

# The actions that start a task, and the status that each other one leaves.
STARTS = ["start", "resume"]
SETTLES = {"pause": "paused", "complete": "completed", "skip": "skipped", "reset": "pending", "carryover": "deferred"}
TASK_STATUSES = ["pending", "active", "paused", "completed", "skipped", "deferred"]
PLAN_ACTIONS = ["plan_pause", "plan_resume"]
#: Seconds of a block of actions; a busy plan is scanned in as many tasks as it has blocks.
BLOCK_SECONDS = 3_600
_PLAN, _AT = ["learner_id", "plan_date"], ["ts", "event_id"]


def _block() -> Column:
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / BLOCK_SECONDS)


def effective_actions(actions: DataFrame) -> DataFrame:
    """The actions that have an effect, with ``ends`` for starts: the (ts, event_id) at which the
    activity ends, null if it is open.

    ``actions``: learner_id, plan_date, event_id, ts, task_id, action; order is by ``ts`` and then
    ``event_id``. Starts while the plan is paused are rejected, and so are unknown actions.
    """
    action, at = F.col("action"), F.struct(*_AT)
    known = actions.filter(action.isin(*STARTS, *SETTLES, *PLAN_ACTIONS))
    state = Running("last", F.when(action.isin(*PLAN_ACTIONS), action == "plan_pause"), inclusive=False)
    rows = running(known, _PLAN, _AT, _block(), {"paused": state})
    rows = rows.filter(~action.isin(*STARTS) | ~F.coalesce("paused", F.lit(False))).drop("paused")
    starts = action.isin(*STARTS)
    before = Running("last", F.when(starts, F.col("task_id")), inclusive=False)
    rows = running(rows, _PLAN, _AT, _block(), {"before": before})
    # The first of some starts of one task in a row stops the task before.
    other = starts & ~F.col("before").eqNullSafe(F.col("task_id"))
    stops = {"other": Running("last", F.when(other, at), inclusive=False), "plan_pause": Running("last", F.when(action == "plan_pause", at), inclusive=False)}
    rows = running(rows, _PLAN, _AT, _block(), stops, reverse=True)
    settled = {"settled": Running("last", F.when(action.isin(*SETTLES), at), inclusive=False)}
    rows = running(rows, [*_PLAN, "task_id"], _AT, _block(), settled, reverse=True)
    ends = F.least("other", "plan_pause", "settled")
    return rows.select(*actions.columns, F.when(starts, ends).alias("ends"))


def task_times(actions: DataFrame, as_of: str) -> DataFrame:
    """``learner_id, plan_date, task_id, actual_seconds``: whole seconds of every activity, summed; an
    activity that is open counts up to ``as_of``. A start of a task that is active keeps its first start."""
    starts = effective_actions(actions).filter(F.col("action").isin(*STARTS))
    # Starts of one activity end alike; those that are open have no end.
    activity = starts.groupBy(*_PLAN, "task_id", "ends").agg(F.min("ts").alias("began"))
    until = F.coalesce(F.col("ends.ts"), F.lit(as_of).cast("timestamp_ntz"))
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))) / 1_000_000))
    times = activity.withColumn("seconds", seconds.cast("bigint"))
    return times.groupBy(*_PLAN, "task_id").agg(F.sum("seconds").alias("actual_seconds"))


def task_status(actions: DataFrame) -> DataFrame:
    """``learner_id, plan_date, task_id, status, completed_at, carried_to`` of every task that an action
    with an effect names."""
    rows = staged(effective_actions(actions), "actions")
    action, at = F.col("action"), F.struct(*_AT)
    own = rows.filter(~action.isin(*PLAN_ACTIONS))
    leaves = F.create_map(*[F.lit(x) for pair in SETTLES.items() for x in pair])
    last = own.groupBy(*_PLAN, "task_id").agg(
        F.max_by(F.struct("action", "ends"), at).alias("last"),
        F.max_by(F.when(action == "complete", F.col("ts")), F.when(action.isin("complete", "reset"), at)).alias("completed_at"),
        F.max(F.when(action == "carryover", F.date_add("plan_date", 1))).alias("carried_to"),
    )
    started = F.col("last.action").isin(*STARTS)
    # A start that something else ended leaves the task paused.
    status = F.when(started, F.when(F.col("last.ends").isNull(), "active").otherwise("paused")).otherwise(leaves[F.col("last.action")])
    return last.select(*_PLAN, "task_id", status.alias("status"), "completed_at", "carried_to")


NO_TASKS = "无"
#: Plan ids of a block where tasks of many plans are numbered.
PLANS_PER_BLOCK = 1_000


def normalize_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with known statuses (others are pending), minutes and seconds of 0 or more, and an order (where
    it is null or 0, the place by task id). ``tasks``: plan_id, plan_date, task_id, ord, planned_minutes,
    actual_seconds, status, active_started_at."""
    place = running(tasks, ["plan_id"], ["task_id"], F.floor(F.col("task_id") / PLANS_PER_BLOCK), {"place": Running("sum", F.lit(1).cast("bigint"))})
    at_least = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).cast("bigint")
    given = F.when(F.coalesce("ord", F.lit(0)) != 0, F.col("ord")).otherwise(F.col("place")).cast("bigint")
    status = F.when(F.trim("status").isin(*TASK_STATUSES), F.trim("status")).otherwise("pending")
    return place.select("plan_id", "plan_date", "task_id", given.alias("ord"), at_least(F.col("planned_minutes")).alias("planned_minutes"), at_least(F.col("actual_seconds")).alias("actual_seconds"), status.alias("status"), "active_started_at")


def plan_totals(tasks: DataFrame, as_of: str) -> DataFrame:
    """``plan_id, planned_minutes, actual_seconds, completed_count, task_count`` of normalised tasks; an
    active one counts up to ``as_of``, in whole seconds."""
    since = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("active_started_at").cast("timestamp"))
    running_for = F.when((F.col("status") == "active") & F.col("active_started_at").isNotNull(), F.greatest(F.lit(0), F.floor(since / 1_000_000))).otherwise(0)
    return tasks.groupBy("plan_id").agg(
        F.sum("planned_minutes").alias("planned_minutes"), F.sum(F.col("actual_seconds") + running_for).cast("bigint").alias("actual_seconds"),
        F.count_if(F.col("status") == "completed").alias("completed_count"), F.count(F.lit(1)).alias("task_count"),
    )


def carry_over(tasks: DataFrame) -> DataFrame:
    """``plan_date, plan_id, task_id, ord, status, actual_seconds, carried_from``: deferred tasks as new ones of
    the next day, numbered after those that the day has."""
    held = tasks.groupBy("plan_date").agg(F.count(F.lit(1)).alias("held"))
    moved = tasks.filter("status = 'deferred'").select(F.date_add("plan_date", 1).alias("plan_date"), F.col("plan_date").alias("carried_from"), "plan_id", "task_id", "ord")
    placed = running(moved, ["plan_date"], ["plan_id", "ord", "task_id"], F.floor(F.col("plan_id") / PLANS_PER_BLOCK), {"place": Running("sum", F.lit(1).cast("bigint"))})
    joined = placed.join(held, "plan_date", "left")
    order = F.col("place") + F.coalesce("held", F.lit(0))
    return joined.select("plan_date", "plan_id", "task_id", order.alias("ord"), F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("actual_seconds"), "carried_from")


def plan_versions(saves: DataFrame, kept: int = 100) -> tuple[DataFrame, DataFrame]:
    """(versions, history). Versions: save_seq, plan_date, version of every save. History: the plans with
    tasks that a later save of their date replaced, the ``kept`` last replaced of all dates.
    ``saves``: save_seq, plan_date, has_tasks, effective_minutes; order is by ``save_seq``."""
    block = F.floor(F.col("save_seq") / PLANS_PER_BLOCK)
    numbered = running(saves, ["plan_date"], ["save_seq"], block, {"version": Running("sum", F.lit(1).cast("bigint"))})
    replaced = running(saves, ["plan_date"], ["save_seq"], block, {"replaced_by": Running("last", F.col("save_seq"), inclusive=False)}, reverse=True)
    history = replaced.filter("has_tasks AND replaced_by IS NOT NULL").orderBy(F.desc("replaced_by")).limit(kept)
    return numbered.select("save_seq", "plan_date", "version"), history.select("save_seq", "plan_date", "effective_minutes", "replaced_by")


def daily_reports(feedback: DataFrame) -> DataFrame:
    """The latest feedback of each date, with counters of 0 or more."""
    names = ["actual_minutes", "questions_completed", "questions_correct"]
    last = feedback.groupBy("report_date").agg(F.max_by(F.struct(*names), "save_seq").alias("r"))
    return last.select("report_date", *[F.greatest(F.lit(0), F.coalesce(F.col(f"r.{n}"), F.lit(0))).cast("bigint").alias(n) for n in names])


def report_lists(tasks: DataFrame) -> DataFrame:
    """``plan_id, completed, unfinished``: titles in order of the plan. ``tasks``: plan_id, ord, task_id, title,
    status. A plan's report is one line of text by nature."""
    def titles(keep: Column) -> Column:
        held = F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "task_id", "title"))))
        text = F.array_join(F.transform(held, lambda x: x["title"]), "、")
        return F.when(text == "", NO_TASKS).otherwise(text)

    done = F.col("status") == "completed"
    return tasks.groupBy("plan_id").agg(titles(done).alias("completed"), titles(~F.col("status").isin("completed", "skipped")).alias("unfinished"))


def plan_progress(totals: DataFrame, effective: Column | None = None) -> DataFrame:
    """``plan_id, progress``: per cent of the planned minutes (``effective`` ones where above 0), halves up,
    100 at most, 0 without a plan."""
    planned = F.col("planned_minutes") if effective is None else F.when(effective > 0, effective).otherwise(F.col("planned_minutes"))
    share = F.round(F.col("actual_seconds").cast("decimal(18,0)") * 100 / (planned.cast("decimal(12,0)") * 60), 0).cast("bigint")
    return totals.select("plan_id", F.when(planned > 0, F.least(F.lit(100), share)).otherwise(0).cast("bigint").alias("progress"))
