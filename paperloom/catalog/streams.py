"""X*: streams over the files of a folder, with the batch results they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..fixtures import VIEWS
from ..functions.staging import shared_dir
from ..operators import jobs as jb, ledger as lg, records as rc
from ..streaming import LogSink, daily_study, latest_times, retention_stream, run_available, run_to_table, timer_stream
from . import ledger as ledger_queries, library as library_queries, plans as plan_queries
from .registry import query


def _stream(r, table: str) -> DataFrame:
    """The files of a table, one a batch. The pattern makes a table of one file a folder of it."""
    schema = getattr(r, table).schema
    return r.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{r.sf_dir}/{table}.parque[t]")


def _view(r, name: str, table: str) -> DataFrame:
    return r.spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {source}"), source=_stream(r, table))


def _all_files(r, name: str, table: str) -> DataFrame:
    """A view over all files in one batch: the watermark moves between batches, and files need not be in order of time."""
    source = r.spark.readStream.schema(getattr(r, table).schema).parquet(f"{r.sf_dir}/{table}.parque[t]")
    return r.spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {source}"), source=source)


@query("X1", f"WITH {ledger_queries._STATUS} SELECT entry_id, status, wrong_count FROM status")
def _ledger(r):
    sink = LogSink(r.spark, ["entry_id"], ["event_id"], lg.ledger_status)
    run_available(_view(r, "v_ledger_events", "events"), sink)
    return sink.state()


@query("X4", """SELECT learner_id, paper_id, arg_max(record_id, (mtime, record_id)) AS record_id, arg_max(notes, (mtime, record_id)) FILTER (notes IS NOT NULL) AS notes, greatest(0, arg_max(duration_seconds, (mtime, record_id))) AS duration_seconds
FROM v_submissions GROUP BY learner_id, paper_id""")
def _drafts(r):
    keys = ["learner_id", "paper_id"]
    sink = LogSink(r.spark, keys, ["record_id"], lambda events: rc.draft_upsert(events, keys))
    run_available(_view(r, "v_submissions", "orders"), sink)
    return sink.state()


@query("X6", """SELECT user_id AS learner_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS seconds, count(*) AS sessions FROM events
GROUP BY user_id, CAST(ts AS DATE) HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _daily(r):
    # All files in one batch: the watermark moves between batches, and files need not be in order of time.
    events = r.spark.readStream.schema(r.events.schema).parquet(f"{r.sf_dir}/events.parque[t]")
    days = daily_study(events.select(F.col("user_id").alias("learner_id"), "ts", F.col("value").alias("seconds")))
    path = f"{shared_dir(r.spark)}/daily-{uuid.uuid4().hex}"
    days.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return r.spark.read.schema(days.schema).parquet(f"{path}/out").withColumn("seconds", F.round("seconds", 6))


# What the watermark has passed when the events are over: an hour before the last one, in milliseconds.
_PASSED = "epoch_us({0}) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM {1})"
_ACTIONS = plan_queries._ACTIONS.replace("FROM v_actions", f"FROM (SELECT * FROM v_actions WHERE {_PASSED.format('ts', 'v_actions')})")


@query("X2", f"""WITH {_ACTIONS}, activity AS (SELECT learner_id, plan_date, task_id, ends, min(ends_at) AS until, min(ts) AS began FROM ended WHERE ends IS NOT NULL GROUP BY learner_id, plan_date, task_id, ends),
spent AS (SELECT learner_id, plan_date, task_id, CAST(sum(greatest(0, (epoch_us(until) - epoch_us(began)) // 1000000)) AS BIGINT) AS seconds FROM activity GROUP BY learner_id, plan_date, task_id),
own AS (SELECT f.*, e.ends, row_number() OVER (PARTITION BY learner_id, plan_date, task_id ORDER BY n DESC) AS rn FROM effective f LEFT JOIN ended e USING (learner_id, plan_date, task_id, n) WHERE action NOT IN ('plan_pause', 'plan_resume'))
SELECT learner_id, plan_date, task_id, coalesce(seconds, 0) AS actual_seconds, CASE action WHEN 'pause' THEN 'paused' WHEN 'complete' THEN 'completed' WHEN 'skip' THEN 'skipped' WHEN 'reset' THEN 'pending' WHEN 'carryover' THEN 'deferred' ELSE CASE WHEN ends IS NULL THEN 'active' ELSE 'paused' END END AS status
FROM own LEFT JOIN spent USING (learner_id, plan_date, task_id) WHERE rn = 1""")
def _timers(r):
    return latest_times(run_to_table(r.spark, timer_stream(_all_files(r, "v_actions", "events")), "timers"))


@query("X3", f"""WITH e AS (SELECT * FROM v_retention WHERE {_PASSED.format('ts', 'v_retention')}), s AS (SELECT *, lag(kind) OVER w AS before, min(CASE WHEN kind = 'restore' THEN ts END) OVER (PARTITION BY item_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS restored FROM e WINDOW w AS (PARTITION BY item_id ORDER BY ts, event_id))
SELECT item_id, CAST(epoch_us(min(ts + INTERVAL 15 DAY)) AS BIGINT) AS purged_us FROM s WHERE kind = 'trash' AND coalesce(before, 'restore') = 'restore' AND (restored IS NULL OR restored >= ts + INTERVAL 15 DAY) GROUP BY item_id HAVING {_PASSED.format('min(ts + INTERVAL 15 DAY)', 'v_retention')}""")
def _retained(r):
    return run_to_table(r.spark, retention_stream(_all_files(r, "v_retention", "events")), "retention").select("item_id", F.unix_micros("purged_at").alias("purged_us"))


@query("X5", library_queries.JOB_STATE)
def _jobs(r):
    sink = LogSink(r.spark, ["job_id"], ["event_id"], jb.job_state)
    run_available(_view(r, "v_jobs", "events"), sink)
    return sink.state()
